"""Secret scans through a trigram inverted index, in DataFrame functions only.

Each rule's Boolean trigram query is derived from its regex (``tidewatch.llm.trigrams``). The index
is a table of postings (trigram, key) over all texts, case folded, for the trigrams that some
query asks for; a text's key is its hash, so that copies share their postings. Intersecting the
postings of a key tells which rules it is a candidate of. Texts meet their keys in a left join and
are searched with their candidates' regexes alone; rules whose query asks for nothing search every
text. Queries hold no negation, so two texts under one key could only gain candidates: what is
found is exact.

Copies of one text share a key: keys are dealt over ``SALTS`` salts on both sides of the join.

Spans are code points, end exclusive: a text is split by the regex and the matches' and gaps'
lengths are summed up, in chunks of about sqrt(n) matches, as a fold that grows an array copies it
at every step. A failing match (too short) still consumes its text, as the base asks.

Defined results: null text counts as empty (no spans); a text of many matches costs little more
than its matches; other columns are left alone, whatever their names; repeated rows give repeated
results; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import materialise, table
from tidewatch.llm.trigrams import Query, query_of, vocabulary


@dataclass(frozen=True)
class Rule:
    """``pattern``: whole match is group 0; ``least``: characters that group ``group`` needs."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


#: The base kinds in their listed order, with their patterns and least lengths.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, True),
)
#: Further kinds that the method adds.
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + ADDED
#: A private key from its BEGIN to its END line; the BEGIN line alone where no END follows before another mark.
KEY_BLOCK = r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----(?:[^-]*+(?:-{1,4}+[^-]++)*+-----END [A-Z ]{0,24}PRIVATE KEY-----)?"
#: What redaction masks: the rules, with whole private keys.
REDACTED = tuple(replace(r, pattern=KEY_BLOCK) if r.kind == "pem" else r for r in RULES)


#: Salts that the copies of one text are dealt over.
SALTS = 8
#: Characters of a piece of a text that is cut; pieces of a group of them.
PIECE, GROUP = 4096, 64

SPANS = "array<struct<start:int,ord:int,stop:int,kind:string>>"


def postings(docs: DataFrame, text: Column, trigrams: list[str]) -> DataFrame:
    """(trigram, key): which texts hold which of ``trigrams``, case folded; each pair once."""
    low = docs.select(F.xxhash64(text).alias("key"), F.lower(text).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select("key", F.explode(held).alias("trigram")).distinct()


def holds(query: Query, has: Column) -> Column:
    """Whether a set of trigrams satisfies a query."""
    out = F.lit(True)
    for clause in query:
        some = F.lit(False)
        for conjunction in sorted(map(sorted, clause)):
            every = F.lit(True)
            for t in conjunction:
                every = every & F.array_contains(has, t)
            some = some | every
        out = out & some
    return out


def candidates(index: DataFrame, queries: list[Query]) -> DataFrame:
    """(key, rules): the places of the queries that a key's postings satisfy; keys with none are left out."""
    has = index.groupBy("key").agg(F.collect_set("trigram").alias("has"))  # no more than the rules ask for
    rules = F.array_compact(F.array(*[F.when(holds(q, F.col("has")), F.lit(i)) for i, q in enumerate(queries) if q]))
    return has.select("key", rules.alias("rules")).where(F.size("rules") > 0)


def quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def bound(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def folded(items: str, state: str, item_type: str, step: str, emit: str) -> str:
    """SQL for a fold over the array ``items`` that emits an item a step: struct<at, out>.

    ``step`` and ``emit`` are the next state and the item, from ``acc.at`` and ``x``. Items are
    gathered chunk by chunk, so that n steps copy about n * sqrt(n) references, not n * n.
    """
    none, nested = f"cast(array() as array<{item_type}>)", f"cast(array() as array<array<{item_type}>>)"
    inner = f"aggregate(part, named_struct('at', far.at, 'out', {none}), (acc, x) -> named_struct('at', {step}, 'out', concat(acc.out, array({emit}))))"
    chunked = "transform(sequence(0, greatest(size(all) - 1, 0) div wide), j -> slice(all, j * wide + 1, wide))"
    outer = f"aggregate(parts, named_struct('at', {state}, 'out', {nested}), (far, part) -> {bound(inner, 'one', 'named_struct(' + repr('at') + ', one.at, ' + repr('out') + ', concat(far.out, array(one.out)))')}, far -> named_struct('at', far.at, 'out', flatten(far.out)))"
    return bound(items, "all", bound("greatest(cast(ceil(sqrt(size(all))) as int), 1)", "wide", bound(chunked, "parts", outer)))


def spans_of(text: str, rule: Rule) -> str:
    """SQL for the rule's matches in column ``text``: array<struct<start,stop>>, in order."""
    p = quoted(rule.pattern)
    kept = f", regexp_extract_all({text}, {p}, {rule.group})" if rule.group else ""
    zipped = f"filter(arrays_zip(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0){kept}), x -> x['1'] is not null)"
    keep = f"length(x['{2 if rule.group else 1}']) >= {rule.least}" if rule.least else "true"
    stop = "acc.at + length(x['0']) + length(x['1'])"
    emit = f"named_struct('start', acc.at + length(x['0']), 'stop', {stop}, 'ok', {keep})"
    return f"filter({folded(zipped, '0', 'struct<start:int,stop:int,ok:boolean>', stop, emit)}.out, s -> s.ok)"


def scan(docs: DataFrame, *, text_col: str = "text", rules: tuple[Rule, ...] = RULES, out: str = "secret_spans") -> DataFrame:
    """``docs`` with ``out``: array<struct<start,ord,stop,kind>>, sorted by start, then listed kind."""
    queries = [query_of(r.pattern) for r in rules]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    df = docs.withColumn("__scan_text", text)
    if any(queries):
        index = materialise(postings(docs, text, vocabulary(queries)), "postings")
        found = candidates(index, queries).select(F.col("key").alias("__scan_key"), F.col("rules").alias("__scan_rules"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__scan_salt"))
        df = df.withColumn("__scan_key", F.xxhash64("__scan_text")).withColumn("__scan_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        df = df.join(found, ["__scan_key", "__scan_salt"], "left")
    parts = []
    for i, r in enumerate(rules):
        spans = F.expr(f"transform({spans_of('__scan_text', r)}, x -> named_struct('start', x.start, 'ord', {i}, 'stop', x.stop, 'kind', '{r.kind}'))")
        here = F.expr(f"__scan_text rlike {quoted(r.pattern)}")
        parts.append(F.when(F.coalesce(F.array_contains("__scan_rules", i), F.lit(False)) & here if queries[i] else here, spans))
    none = F.expr(f"cast(array() as {SPANS})")
    return df.select(*[F.col(f"`{c}`") for c in docs.columns], F.array_sort(F.concat(*[F.coalesce(x, none) for x in parts])).alias(out))


def redact(docs: DataFrame, *, text_col: str = "text", mark: str = "[SECRET]", rules: tuple[Rule, ...] = REDACTED) -> DataFrame:
    """Same columns and rows; each secret in ``text_col`` is replaced by ``mark``. Null stays null, an empty table empty.

    Spans that overlap share a mark. What lies between them is cut from pieces of the text, as a
    place in a text is found by walking there.
    """
    df = scan(docs, text_col=text_col, rules=rules, out="__spans")
    t = f"`{text_col}`"
    gaps = folded("__spans", "0", "struct<lo:int,hi:int,marked:boolean>", "greatest(acc.at, x.stop)", "named_struct('lo', acc.at, 'hi', x.start, 'marked', x.start >= acc.at)")
    keep = bound(gaps, "g", f"concat(filter(g.out, p -> p.marked), array(named_struct('lo', g.at, 'hi', length({t}), 'marked', false)))")
    inside = "filter({of}, p -> (p.lo < {hi} and p.hi > {lo}) or (p.marked and p.hi >= {lo} and p.hi < {hi}))"
    at, wide = f"(k * {GROUP} + i) * {PIECE}", PIECE * GROUP
    cut = f"concat(substr(piece, greatest(p.lo - {at}, 0) + 1, least(p.hi - {at}, {PIECE}) - greatest(p.lo - {at}, 0)), if(p.marked and p.hi >= {at} and p.hi < {at} + {PIECE}, '{mark}', ''))"
    one = f"array_join(transform({inside.format(of='near', lo=at, hi=f'{at} + {PIECE}')}, p -> {cut}), '')"
    group = bound(inside.format(of="kept", lo=f"k * {wide}", hi=f"(k + 1) * {wide}"), "near", f"array_join(transform(slice(pieces, k * {GROUP} + 1, {GROUP}), (piece, i) -> {one}), '')")
    whole = bound(keep, "kept", bound(f"regexp_extract_all({t}, r'(?s).{{1,{PIECE}}}', 0)", "pieces", f"array_join(transform(sequence(0, (size(pieces) - 1) div {GROUP}), k -> {group}), '')"))
    return df.withColumn(text_col, F.when(F.size("__spans") > 0, F.expr(whole)).otherwise(F.col(t))).drop("__spans")


def digest(scanned: DataFrame, *, spans: str = "secret_spans", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_<base kind>, base_sha256 and spans of a scanned table."""
    n_base = sum(r.base for r in rules)
    join = "array_join(transform({}, s -> concat(s.kind, ':', s.start, ':', s.stop)), ',')"
    base = f"filter({spans}, s -> s.ord < {n_base})"
    return scanned.select(
        "doc_id",
        *[F.expr(f"cast(size(filter({spans}, s -> s.ord = {i})) as bigint)").alias(f"n_{r.kind}") for i, r in enumerate(rules) if r.base],
        F.expr(f"sha2({join.format(base)}, 256)").alias("base_sha256"),
        F.expr(join.format(spans)).alias("spans"),
    )


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(scan(docs))
