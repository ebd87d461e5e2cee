"""Signs of design in C sources: each detector gives one hint (category, kind, involved) or none."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import all_matches, has

#: Names and keywords that the detectors look for.
COMPRESSION = ("deflate", "inflate", "compress", "decompress", "lz77", "huffman", "zlib")
CHECKSUM = ("crc32", "crc16", "adler32", "checksum")
CRYPTO = ("sha256", "sha1", "md5", "aes", "encrypt", "decrypt", "hmac", "pbkdf")
GRAMMAR = ("expression", "term", "factor", "primary", "unary", "atom", "statement")
EVENTS = ("select(", "poll(", "epoll", "kqueue", "event_loop", "dispatch")
STDIO = ("fopen", "fclose", "fread", "fwrite", "fprintf", "fscanf", "fgets", "fputs")
MUTEX = ("pthread_mutex_lock", "pthread_mutex_unlock", "pthread_mutex_init", "EnterCriticalSection", "LeaveCriticalSection")
ATOMIC = ("atomic_load", "atomic_store", "atomic_fetch_add", "__atomic", "__sync_fetch", "InterlockedIncrement")

@dataclass(frozen=True)
class Sign:
    """What tells a kind of design. A test is a text that a source must hold; `low:` looks in lower case, `re:` for a pattern.

    All groups of `needs` must hold, a group by any of its tests. `kinds` are tried in turn, the first whose tests hold
    (any of them, or none given) names the hint. `shows` says what is involved: `name:` the first group of all matches of
    a pattern, `word:` those of the given words that the source holds, `fixed:` itself, `states:` how many distinct
    names there are. Without anything found, `instead` stands.
    """

    category: str
    kinds: tuple[tuple[str, tuple[str, ...]], ...]
    needs: tuple[tuple[str, ...], ...]
    shows: tuple[str, ...]
    instead: str | None = None


def words(prefix: str, names: tuple[str, ...], suffix: str = "") -> tuple[str, ...]:
    return tuple(f"{prefix}{n}{suffix}" for n in names)


#: The signs, in the order of their hints, with the names that stand for what is not found.
SIGNS = (
    Sign("data", (("doubly_linked_list", ("*prev;", "->prev")), ("linked_list", ())), ((r"re:struct\s+\w+\s*\*\s*next\s*;",), ("->next",)), (r"name:(?s)struct\s+(\w+)\s*\{[^}]*\*\s*next\s*;[^}]*\}",), "(struct with ->next)"),
    Sign("data", (("hash_table", ()),), (("**buckets", "** buckets", r"re:(?i)\b(hash|djb2|fnv|murmur)\b"), ("**buckets", "** buckets", "low:capacity"), ("**buckets", "** buckets", "low:size"), ("hash", "Hash")), (r"name:struct\s+(\w*[Hh]ash\w*)",), "(hash table structs)"),
    Sign("data", (("tree", ()),), (("*left", "-> left"), ("*right", "-> right")), (r"name:(?s)struct\s+(\w+)\s*\{[^}]*\*\s*left\s*;[^}]*\*\s*right\s*;[^}]*\}",), "(struct with left/right)"),
    Sign("data", (("stack", ()),), ((r"re:\bpush\s*\(",), (r"re:\bpop\s*\(",), ("low:top", "low:->sp")), ("fixed:push", "fixed:pop")),
    Sign("data", (("queue", ()),), (("low:enqueue", "low:queue_push"), ("low:dequeue", "low:queue_pop")), ("fixed:enqueue", "fixed:dequeue")),
    Sign("algorithm", (("sort", ()),), (("qsort(",),), ("fixed:qsort", r"name:int\s+(\w+)\s*\(\s*const\s+void")),
    Sign("algorithm", (("sort", ()),), (("!qsort(",), ("low:swap", "temp ="), (r"re:for\s*\([^)]*\)\s*\{[^}]*for\s*\(",)), ("fixed:(manual sort detected)",)),
    Sign("algorithm", (("binary_search", ()),), (("low:low", "low:left"), ("low:high", "low:right"), (r"re:\bmid\b\s*=.*[/+].*2", ">> 1")), (r"name:(?i)\b(\w*search\w*)\s*\(",), "(binary search pattern)"),
    Sign("algorithm", (("compression", ()),), (words("low:", COMPRESSION),), words("word:low:", COMPRESSION)),
    Sign("algorithm", (("checksum", ()),), (words("low:", CHECKSUM),), words("word:low:", CHECKSUM)),
    Sign("algorithm", (("crypto", ()),), (words("low:", CRYPTO),), words("word:low:", CRYPTO)),
    Sign("control", (("state_machine", ()),), ((r"re:(?i)\bSTATE_\w+", r"re:enum\s+\w*[Ss]tate\w*"), (r"re:switch\s*\(\s*\w*->?\s*state", r"re:->?\s*state\s*=\s*STATE_", r"re:->?\s*state\s*=\s*\w+_STATE")), (r"states:STATE_(\w+)",)),
    Sign("control", (("recursive_descent_parser", ()),), (("parsers:",),), (r"distinct:\b(parse_\w+)\s*\(",)),
    Sign("control", (("event_loop", ()),), (words("low:", EVENTS),), ("fixed:(event dispatch)",)),
    Sign("control", (("goto_cleanup", ()),), ((r"re:\bgoto\s+\w+",), (r"re:(?m)^\w+:\s*$",)), ("fixed:(goto-based resource cleanup)",)),
    Sign("io", (("file_readwrite", ()),), (("two:",),), words("word:", STDIO, "(")),
    Sign("io", (("buffer_management", ()),), (("low:buffer", "low:buf_size"), ("low:read(", "low:recv("), ("low:write(", "low:send(")), ("fixed:(buffered I/O)",)),
    Sign("io", (("serialization", ()),), (("low:serialize", "low:json"), ("low:serialize", "low:parse", "low:print")), ("fixed:(serialization/deserialization)",)),
    Sign("concurrency", (("mutex", ()),), (MUTEX,), words("word:", MUTEX)),
    Sign("concurrency", (("thread_creation", ()),), (("pthread_create", "CreateThread"),), words("word:", ("pthread_create", "pthread_join", "CreateThread"))),
    Sign("concurrency", (("atomic", ()),), (tuple(f"low:{a.lower()}" for a in ATOMIC),), words("word:low:", ATOMIC)),
)


def _holds(text: Column, low: Column, test: str) -> Column:
    how, _, what = test.partition(":") if test.split(":")[0] in ("low", "re") else ("", "", test)
    if test.startswith("!"):
        return ~text.contains(test[1:])
    return low.contains(what.lower()) if how == "low" else text.rlike(what) if how == "re" else text.contains(what)


def _shown(text: Column, low: Column, show: str) -> Column:
    """What one entry of a sign's `shows` gives, an array."""
    how, _, what = show.partition(":")
    if how == "word":
        name = what.removeprefix("low:").removesuffix("(")
        return F.array_compact(F.array(F.when(_holds(text, low, what), F.lit(name))))
    if how == "fixed":
        return F.array(F.lit(what))
    found = all_matches(text, what)
    if how == "states":
        return F.array(F.concat(F.size(F.array_distinct(found)).cast("string"), F.lit(" states detected")))
    return F.array_sort(F.array_distinct(found)) if how == "distinct" else found


def _hint(text: Column, low: Column, sign: Sign) -> Column:
    found = F.flatten(F.array(*[_shown(text, low, s) for s in sign.shows]))
    any_of = lambda tests: reduce(lambda a, b: a | b, [_holds(text, low, x) for x in tests])
    if sign.needs == (("two:",),):
        when = F.size(found) >= 2
    elif sign.needs == (("parsers:",),):
        when = (F.size(found) >= 3) & (F.size(F.filter(found, lambda f: has(f, *GRAMMAR))) >= 2)
    else:
        when = reduce(lambda a, b: a & b, [any_of(group) for group in sign.needs])
    kind = F.coalesce(*[F.when(any_of(tests), F.lit(k)) if tests else F.lit(k) for k, tests in sign.kinds])
    involved = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(sign.instead))) if sign.instead else found
    return F.when(when, F.struct(F.lit(sign.category).alias("category"), kind.alias("kind"), involved.alias("involved")))


def memory_kind(text: Column) -> Column:
    return F.when(text.contains("realloc("), "resize").when(text.contains("malloc(") & text.contains("free("), "pairs").when(text.contains("calloc("), "zeroed").otherwise("ownership")


def hints(text: Column) -> Column:
    """array<struct<category, kind, involved>> of the signs that hold, in their order; names come as found, with repeats.

    Memory is not among them: what it involves follows from the bodies of functions (with_memory).
    """
    low = F.lower(text)
    return F.array_compact(F.array(*[_hint(text, low, s).cast("struct<category:string,kind:string,involved:array<string>>") for s in SIGNS]))


def with_memory(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, hints): those of each text, led by that on memory where functions take it or give it back (D-01).

    Functions are told by the span table of the text (operators.spans).
    """
    from ..operators.spans import allocating, c_tokens

    found = allocating(c_tokens(df, key, text), key)
    memory = F.struct(F.lit("memory").alias("category"), memory_kind(F.col(text)).alias("kind"), F.col("functions").alias("involved"))
    rows = df.select(key, text).join(found, key, "left")
    return rows.select(key, F.concat(F.when(F.col("functions").isNotNull(), F.array(memory)).otherwise(F.array().cast("array<struct<category:string,kind:string,involved:array<string>>>")), hints(F.col(text))).alias("hints"))
