"""Personal data: fixed kinds by pattern, and further identifiers by bootstrapped contexts. DataFrame functions only.

Valid emails, addresses, card and phone numbers are seeds. The words around them induce lexical
patterns (two words before; one before; one before and one after). Other tokens with a digit are
candidates. Patterns and instances form a bipartite graph with counts on its edges; in each round a
pattern's confidence is the share of its weight that lies on trusted instances, and an instance's
trust the mean confidence of its patterns. Candidates in a pattern that is confident and supported
by enough distinct seeds are identifiers of kind `id`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm._shared import documents, free_names, written

KINDS = ("email", "ip", "card", "phone")
ADDED = "id"
ROUNDS = 3
#: Added to a pattern's weight, so that a pattern seen a few times is not confident.
SMOOTHING = 2.0
CONFIDENCE, SEEDS = 0.6, 5
MIN_CANDIDATE = 6
#: Trusted patterns are broadcast up to so many characters of them together; beyond, their join is shuffled.
BROADCAST_CHARS = 16 << 20

_LOCAL = "A-Za-z0-9._%+-"
#: The contract's patterns. Look-behind and possessive repeats keep long runs linear and match the same:
#: a leftmost match starts where a run of its first class starts, or where the match before ended.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    ADDED: r"(?<!\S)[^\s0-9]*+[0-9]\S*+",
}
#: What a text must have for a pattern to be tried.
NEEDS = {"email": r"@[A-Za-z0-9-]+\.", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]", ADDED: "[0-9]"}

_BLOCK = 256


def _let(value: str, name: str, body: str) -> str:
    """SQL for body with name standing for value, computed once: a lambda's variable is never inlined."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _prefix_sums(values: str) -> str:
    """SQL for the inclusive prefix sums of an array of ints, in blocks so that long arrays stay near linear."""
    add = "(x, y) -> x + y"
    block = f"slice({values}, cast(b * {_BLOCK} + 1 AS int), {_BLOCK})"
    sums = f"transform(sequence(0, (size({values}) - 1) div {_BLOCK}), b -> aggregate({block}, 0, {add}))"
    before = _let(sums, "sums", f"transform(sums, (s, b) -> aggregate(slice(sums, 1, b), 0, {add}))")
    within = _let(block, "own", f"transform(own, (v, i) -> o + aggregate(slice(own, 1, i + 1), 0, {add}))")
    return (
        f"CASE WHEN size({values}) = 0 THEN cast(array() AS array<int>) WHEN size({values}) <= {_BLOCK} THEN transform({values}, (v, i) -> aggregate(slice({values}, 1, i + 1), 0, {add})) "
        f"ELSE flatten(transform({before}, (o, b) -> {within})) END"
    )


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        x = F.substring(digits, i, F.lit(1)).cast("int")
        twice = x * 2 - F.when(x > 4, 9).otherwise(0)
        return total + F.when((F.length(digits) - i) % 2 == 1, twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")).between(0, 3) & (F.when(F.length(F.regexp_replace(p, "^0+", "")) <= 3, F.coalesce(F.regexp_replace(p, "^0+", "").try_cast("int"), F.lit(0))).otherwise(999) <= 255))
    if kind == "card":
        return F.when(F.length(_digits(value)).between(12, 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


#: Words of a context: runs of letters, equals signs and colons.
_CONTEXT = r"\p{L}=:"


def _patterns(before: Column, after: Column) -> Column:
    """Lexical patterns from the text before and after an instance, as far as its neighbours of the same kind.

    Words are whole, however long and however far off; a missing word is written as ^ or $. The text
    before is read backwards, so that no more of it is looked at than the two words take.
    """
    backwards = F.reverse(before)

    def word(text: Column, nth: int) -> Column:
        return F.regexp_extract(text, rf"^[^{_CONTEXT}]*+([{_CONTEXT}]++)" + (rf"[^{_CONTEXT}]++([{_CONTEXT}]++)" if nth > 1 else ""), nth)

    def named(found: Column, none: str) -> Column:
        return F.when(F.length(found) > 0, F.lower(found)).otherwise(F.lit(none))

    one, two, following = named(F.reverse(word(backwards, 1)), "^"), named(F.reverse(word(backwards, 2)), "^"), named(word(after, 1), "$")
    return F.array(F.concat(two, F.lit(" "), one, F.lit(" _")), F.concat(one, F.lit(" _")), F.concat(one, F.lit(" _ "), following))


def _spans(kind: str) -> Column:
    """The valid spans of a kind, from its matches m_, the pieces between them g_, and the matches' ends e_."""
    pieces, ends = F.col(f"g_{kind}"), F.col(f"e_{kind}")

    def span(value: Column, i: Column) -> Column:
        end = F.get(ends, i)
        start, inner = end - F.length(value), value
        if kind == ADDED:
            start += F.length(value) - F.length(F.regexp_replace(value, r"^[^\p{L}0-9+]+", ""))
            inner = F.regexp_replace(F.regexp_replace(value, r"^[^\p{L}0-9+]+", ""), r"[^\p{L}0-9]+$", "")
            end = start + F.length(inner)
        return F.struct(start.alias("s"), end.alias("e"), inner.alias("value"), _patterns(F.get(pieces, i), F.get(pieces, i + 1)).alias("patterns"))

    def valid(x: Column) -> Column:
        return F.length(x["value"]) >= MIN_CANDIDATE if kind == ADDED else _valid(kind, x["value"])

    return F.filter(F.transform(f"m_{kind}", span), valid)


def _marked(kind: str, at: int) -> Column:
    return F.transform(kind, lambda x: F.struct(x["s"].alias("s"), F.lit(at).alias("kind_at"), x["e"].alias("e"), F.lit(kind).alias("kind")))


def _of(kind: str) -> Column:
    return F.filter("spans", lambda x: x["kind"] == kind)


def scan(docs: DataFrame) -> DataFrame:
    """One row a row of docs: doc_id, text_key, and per kind the spans found: struct(s, e, value, patterns).

    Positions count code points, ends exclusive. Each pattern is matched as a list of matches and as
    the pieces between them, whose lengths give the positions. Null text counts as empty.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.xxhash64("text").alias("text_key"))
    none = F.array().cast("array<string>")
    for kind, pattern in PATTERNS.items():
        needed = F.col("text").rlike(NEEDS[kind])
        rows = rows.withColumns({f"m_{kind}": F.when(needed, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none), f"g_{kind}": F.when(needed, F.split("text", pattern, -1)).otherwise(none)})
    rows = rows.drop("text")
    for kind in PATTERNS:
        lens = f"zip_with(m_{kind}, slice(g_{kind}, 1, size(m_{kind})), (m, g) -> length(m) + length(g))"
        rows = rows.withColumn(f"l_{kind}", F.expr(lens))
    for kind in PATTERNS:
        rows = rows.withColumn(f"e_{kind}", F.expr(_prefix_sums(f"l_{kind}")))
    for kind in PATTERNS:
        rows = rows.withColumn(kind, _spans(kind))
    base = F.concat(*(F.transform(kind, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))) for kind in KINDS))
    rows = rows.withColumn("base", base).withColumn(ADDED, F.filter(ADDED, lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))))
    return rows.select("doc_id", "text_key", *PATTERNS)


def confident_patterns(found: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, seeds: int = SEEDS, smoothing: float = SMOOTHING) -> DataFrame:
    """(pattern): those trusted after the rounds over the pattern-instance graph."""
    parts = [found.select(F.explode(kind).alias("x")).select(F.explode("x.patterns").alias("pattern"), F.concat(F.lit(f"{kind}:"), "x.value").alias("instance"), F.lit(kind != ADDED).alias("seed")) for kind in PATTERNS]
    edges = parts[0]
    for part in parts[1:]:
        edges = edges.unionByName(part)
    edges = written(edges.groupBy("pattern", "instance", "seed").agg(F.count(F.lit(1)).cast("double").alias("w")), "edges")
    trust = edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("trust"))
    for k in range(rounds):
        patterns = edges.join(trust, "instance").groupBy("pattern").agg((F.sum(F.col("w") * F.col("trust")) / (F.sum("w") + smoothing)).alias("confidence"), F.sum(F.col("seed").cast("int")).alias("seeds"))
        patterns = written(patterns, "patterns")
        if k + 1 < rounds:
            trust = edges.join(patterns, "pattern").groupBy("instance").agg(F.when(F.max(F.col("seed").cast("int")) == 1, 1.0).otherwise(F.sum(F.col("w") * F.col("confidence")) / F.sum("w")).alias("trust"))
    trusted = patterns.where((F.col("confidence") >= confidence) & (F.col("seeds") >= seeds)).select("pattern")
    # A pattern may hold a third of all candidates: broadcast, its join deals none of them.
    return F.broadcast(trusted) if (trusted.agg(F.sum(F.length("pattern") + 40)).first()[0] or 0) <= BROADCAST_CHARS else trusted


def personal_data(docs: DataFrame, **settings) -> DataFrame:
    """Per row of docs: doc_id, text_key and spans, an ordered array of struct(s, kind_at, e, kind).

    Spans of the four kinds keep their place whatever else is found; added ones overlap none of them.
    Rows that repeat an id are judged each by its own text. An empty table gives an empty result.
    """
    found = written(scan(docs).withColumn("row_id", F.monotonically_increasing_id()), "spans")
    trusted = confident_patterns(found, **settings)
    candidates = found.select("row_id", F.explode(ADDED).alias("x")).select("row_id", "x.s", "x.e", F.explode("x.patterns").alias("pattern"))
    added = candidates.join(trusted, "pattern").groupBy("row_id").agg(F.collect_set(F.struct("s", F.lit(len(KINDS)).alias("kind_at"), "e", F.lit(ADDED).alias("kind"))).alias("added"))
    base = F.concat(*(_marked(kind, i) for i, kind in enumerate(KINDS)))
    rows = found.select("row_id", "doc_id", "text_key", base.alias("base")).join(added, "row_id", "left")
    return rows.select("doc_id", "text_key", F.array_sort(F.when(F.col("added").isNull(), F.col("base")).otherwise(F.concat("base", "added"))).alias("spans"))


def _written_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


#: Documents with spans are broadcast up to so many documents and spans together; beyond, they are joined by a shuffle.
BROADCAST_ENTRIES = 150_000


def redact(docs: DataFrame, broadcast_entries: int = BROADCAST_ENTRIES, **settings) -> DataFrame:
    """docs with each found span of text replaced by its kind in brackets; overlapping spans are replaced as one,
    named after the first. Other columns stay; n_chars, where there is one, is counted anew.

    Every row stays: null texts stay null, rows that repeat an id are redacted each by its own text.
    """
    doc, key, at, runs = free_names(docs, "found_doc", "found_key", "found_spans", "found_runs")
    found = personal_data(docs, **settings).where(F.size("spans") > 0).dropDuplicates(["doc_id", "text_key"])
    found = written(found.select(F.col("doc_id").alias(doc), F.col("text_key").alias(key), F.col("spans").alias(at)), "redactions")
    rows, spans = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(at)), F.lit(0))).first()
    found = F.broadcast(found) if rows + spans <= broadcast_entries else found
    merged = F.expr(f"""aggregate({at}, cast(array() AS array<struct<s: int, e: int, kind: string>>), (a, x) ->
        CASE WHEN size(a) > 0 AND element_at(a, -1).e > x.s
        THEN concat(slice(a, 1, size(a) - 1), array(named_struct('s', element_at(a, -1).s, 'e', greatest(element_at(a, -1).e, x.e), 'kind', element_at(a, -1).kind)))
        ELSE concat(a, array(named_struct('s', x.s, 'e', x.e, 'kind', x.kind))) END)""")
    pieces = F.expr(f"""concat(array_join(transform({runs}, (x, i) -> concat(substring(text, coalesce(get({runs}, i - 1).e, 0) + 1, x.s - coalesce(get({runs}, i - 1).e, 0)), '[', upper(x.kind), ']')), ''),
        substring(text, element_at({runs}, -1).e + 1))""")
    joined = docs.join(found, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(key)), "left")
    out = joined.withColumn(runs, F.when(F.col(at).isNotNull(), merged)).withColumn("text", F.when(F.col(runs).isNull(), F.col("text")).otherwise(pieces))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("spans", lambda x: x["kind"] != ADDED)
    counts = [F.size(_of(kind)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(_written_spans(base), 256).alias("base_sha256"), _written_spans(F.col("spans")).alias("spans"))
