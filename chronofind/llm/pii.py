"""Personal data by bootstrapped contextual extraction [native].

Base entities come from patterns (e-mail, IP, card, phone) with their checks. Secrets have no pattern
of their own: values of some published shapes (digests, access keys) are their seeds, but none is reported
for its shape alone. All identifier-like tokens, those that hold a digit and have six characters or more,
are candidates; quotes, brackets and a key before `=` or `:` don't belong to them. The base entities and the
shapes are seeds: the words around them give lexical patterns (the two words before; the word before and
the word after). Patterns and the different values found in them form a bipartite graph, which Spark
scores in rounds. For a kind, a value of a pattern speaks for it if it is a seed of the kind or stands in
another trusted pattern of it, and against it if it is a seed of another kind; a value that nothing is known
of counts an eighth against it. A pattern's confidence is the share of what speaks for it, one being added to
the whole; with `min_seeds` values for it, one of them a seed, and `min_confidence` it is trusted. Trust only grows, and the rounds
end when no pattern is added. Values in trusted patterns are reported as further entities of the kind.

Everything is DataFrame and SQL functions. Positions are found inside the row: a text is split at a
pattern's matches, and the pieces' lengths are summed up in blocks, so that a text with very many
matches stays cheap. The patterns are written with possessive quantifiers and anchors at run
starts, which leave their matches as they are but bound their time and stack on long runs. A context is
what stands in the `BEFORE` characters before and the `AFTER` characters after a value.

Defined cases: a null text is empty. Rows are judged one by one, so repeated rows and repeated or
null ids are all returned; equal rows count once when patterns are scored. Spans of different kinds may overlap;
discovered ones overlap no base span, but that a secret may hold one. Of a token's kinds the surest counts, then the first
in the order of `KINDS` and `MORE`. Ties in start go by kind in that order, then by end. An empty table gives an empty
result; further columns are not read, whatever their names, and `redacted` returns them as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stored, table

KINDS = ("email", "ip", "card", "phone")

#: Kinds that have no base pattern.
MORE = ("secret",)

MIN_SEEDS = 4
MIN_CONFIDENCE = 0.8
#: What a value of which nothing is known counts against a pattern.
UNKNOWN = 0.125
BEFORE, AFTER = 120, 60

#: The base patterns, as Java regular expressions. `\G` or a run start: where a run of the first class is
#: entered in its middle, it would match from its start as well.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for its pattern to be tried, as SQL.
NEEDS = {
    "email": "contains(_text, '@')",
    "ip": r"_text rlike '[0-9]\\.[0-9]'",
    "card": "_text rlike '[0-9]'",
    "phone": "contains(_text, '+')",
}
#: Identifier-like tokens: runs that hold a digit; what they may not end with is cut off.
CANDIDATE = r"(?<![A-Za-z0-9@._/+-])(?=[A-Za-z@._/+-]*+[0-9])[A-Za-z0-9][A-Za-z0-9@._/+-]*+"
_ENDS = r"[@._/+-]+$"
_LEAST = 6
# Published shapes of secrets, of lower-cased tokens.
SECRETS = (
    r"(?=[0-9]*+[a-f])(?=[a-f]*+[0-9])(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})",
    r"akia[0-9a-z]{16}",
    r"gh[oprsu]_[0-9a-z]{36}",
    r"sk_live_[0-9a-z]{24,}",
    r"aiza[0-9a-z_-]{35}",
)

_IP = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.(?!$)|$)){4}$"
_BLOCK = 64


def _sql(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _valid(kind: str) -> str:
    """SQL condition on a match m."""
    digits = "regexp_replace(m, '[^0-9]', '')"
    if kind == "ip":
        return f"m rlike {_sql(_IP)}"
    if kind == "phone":
        return f"length({digits}) between 9 and 15"
    if kind == "card":
        digit = f"(ascii(substring(reverse({digits}), i, 1)) - 48)"
        luhn = f"aggregate(sequence(1, length({digits})), 0, (a, i) -> a + if(i % 2 = 1, {digit}, if({digit} > 4, {digit} * 2 - 9, {digit} * 2)))"
        return f"if(length({digits}) between 12 and 19, {luhn} % 10 = 0, false)"
    return "true"


def _before(units: str) -> str:
    """SQL array: for each element of an array of lengths, the sum of those before it; in blocks, so that no long array is copied often."""
    blocks = f"transform(sequence(0, (size({units}) - 1) div {_BLOCK}), b -> slice({units}, b * {_BLOCK} + 1, {_BLOCK}))"
    running = "aggregate({0}, array({1}), (acc, u) -> concat(acc, array(element_at(acc, -1) + u)))"
    sums = f"transform({blocks}, x -> aggregate(x, 0, (a, u) -> a + u))"
    offsets = running.format(sums, "0")
    inner = running.format("x.block", "x.offset")
    zipped = f"zip_with({blocks}, slice({offsets}, 1, size({blocks})), (block, offset) -> struct(block, offset))"
    return f"flatten(transform({zipped}, x -> slice({inner}, 1, size(x.block))))"


def _found(rows: DataFrame, name: str, pattern: str, needs: str) -> DataFrame:
    """rows with a column `name`: array of (s, e, m) of the pattern's matches in column _text; needs: a quick condition on texts."""
    rows = rows.withColumn("_m", F.when(F.expr(needs), F.regexp_extract_all("_text", F.lit(pattern), 0)))
    rows = rows.withColumn("_p", F.when(F.size("_m") > 0, F.split("_text", pattern, -1)))
    rows = rows.withColumn("_u", F.expr("zip_with(slice(_p, 1, size(_m)), _m, (p, m) -> length(p) + length(m))"))
    rows = rows.withColumn("_b", F.when(F.size("_m") > 0, F.expr(_before("_u"))))
    spans = "transform(sequence(0, size(_m) - 1), i -> struct(_b[i] + length(_p[i]) as s, _b[i] + _u[i] as e, _m[i] as m))"
    return rows.withColumn(name, F.expr(f"if(size(_m) > 0, {spans}, cast(array() as array<struct<s: int, e: int, m: string>>))")).drop("_m", "_p", "_u", "_b")


def base_spans(docs: DataFrame, text: Column) -> DataFrame:
    """docs with an array column `_base` of (s, k, e), start, kind number, end, and the text as `_text`."""
    rows = docs.withColumn("_text", F.coalesce(text, F.lit("")))
    for i, kind in enumerate(KINDS):
        rows = _found(rows, f"_x{i}", PATTERNS[kind], NEEDS[kind])
        keep = f"filter(_x{i}, x -> {_valid(kind).replace('m rlike', 'x.m rlike').replace('regexp_replace(m,', 'regexp_replace(x.m,')})"
        rows = rows.withColumn(f"_x{i}", F.expr(f"transform({keep}, x -> struct(x.s, {i} as k, x.e))"))
    rows = rows.withColumn("_base", F.expr("array_sort(concat(" + ", ".join(f"_x{i}" for i in range(len(KINDS))) + "))"))
    return rows.drop(*[f"_x{i}" for i in range(len(KINDS))])


def _key(id_col: Column, text: Column) -> Column:
    """Names a row's id and text; equal rows have equal spans."""
    return F.sha2(F.concat(F.sha2(F.coalesce(text, F.lit("")), 256), F.coalesce(F.sha2(id_col.cast("string"), 256), F.lit(""))), 256)


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, _key, base, seen), one row per row of docs: the base spans, and all base entities and (with k null)
    candidates with the words around them. The one pass over the texts that mining needs."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_t"), _key(F.col(id_col), F.col(text_col)).alias("_key"))
    rows = _found(base_spans(rows, F.col("_t")), "_c", CANDIDATE, "_text rlike '[0-9]'")
    cut = f"x.s + length(regexp_replace(x.m, {_sql(_ENDS)}, ''))"
    rows = rows.withColumn("_c", F.expr(f"filter(transform(_c, x -> struct(x.s, cast(null as int) as k, {cut} as e)), x -> x.e - x.s >= {_LEAST})"))
    # what is before is turned round, so that its last words are found from the start; quotes and brackets belong to nothing
    before = f"regexp_replace(reverse(substring(_text, greatest(x.s - {BEFORE - 1}, 1), least(x.s, {BEFORE}))), {_sql('^["(<{' + chr(39) + chr(92) + '[]+')}, '')"
    after = f"substring(_text, x.e + 1, {AFTER})"
    around = [
        rf"lower(reverse(regexp_extract({before}, '^\\s*\\S+\\s+(\\S+)', 1))) as l2",
        rf"lower(reverse(regexp_extract({before}, '^\\s*(\\S+)', 1))) as l1",
        rf"lower(regexp_extract({after}, '^\\S*\\s+(\\S+)', 1)) as r1",
    ]
    value = "lower(substring(_text, x.s + 1, x.e - x.s)) as value"
    rows = rows.withColumn("seen", F.expr(f"transform(concat(_base, _c), x -> struct(x.s, x.k, x.e, {value}, {', '.join(around)}))"))
    return rows.select("id", "_key", F.col("_base").alias("base"), "seen")


def mentions(scanned: DataFrame) -> DataFrame:
    """(key, s, e, k, seed, value, l2, l1, r1): all base entities and, with k null, the candidates that overlap none or
    have the shape of a secret that holds them; seed: the kind that is known of the value."""
    flat = scanned.filter("size(seen) > 0").dropDuplicates(["_key"]).select(F.col("_key").alias("key"), F.inline("seen"))
    shape = "^(?:" + "|".join(SECRETS) + ")$"
    flat = flat.withColumn("seed", F.coalesce("k", F.when(F.col("value").rlike(shape), F.lit(len(KINDS)))))
    # both windows grow from their start: a frame up to the last row would be summed anew for each row
    flat = flat.withColumn("_ended", F.expr("max(if(k is null, null, e)) over (partition by key order by s, e desc, k nulls last rows between unbounded preceding and 1 preceding)"))
    flat = flat.withColumn("_next", F.expr("min(if(k is null, null, s)) over (partition by key order by s desc, e, k nulls first rows between unbounded preceding and 1 preceding)"))
    apart = "coalesce(_ended, -1) <= s and coalesce(_next, e) >= e"
    holds = "seed is not null and coalesce(_ended, -1) <= s"
    return flat.filter(f"k is not null or ({apart}) or ({holds})").select("key", "s", "e", "k", "seed", "value", "l2", "l1", "r1")


def discover(scanned: DataFrame, min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE, rounds: int | None = None) -> DataFrame:
    """(key, found): further entities of a row, as an array of (s, k, e). rounds: at most so many; None: until no pattern is added."""
    spark = scanned.sparkSession
    two = F.when((F.col("l1") != "") & (F.col("l2") != ""), F.concat(F.lit("2 "), "l2", F.lit(" "), "l1"))
    around = F.when((F.col("l1") != "") & (F.col("r1") != ""), F.concat(F.lit("1 "), "l1", F.lit(" _ "), "r1"))
    seen = stored(mentions(scanned).select("key", "s", "e", "k", "seed", "value", F.explode(F.array_compact(F.array(two, around))).alias("pattern")))
    # a value is a seed of one kind: what the patterns took it for, or its shape
    edges = seen.groupBy("pattern", "value").agg(F.min("seed").alias("seed"))
    kinds = range(len(KINDS) + len(MORE))
    per = edges.groupBy("pattern").agg(F.count("*").alias("n"), F.count("seed").alias("known"), *[F.count_if(F.col("seed") == i).alias(f"n{i}") for i in kinds])
    per = per.select("pattern", "n", "known", F.inline(F.array(*[F.struct(F.lit(i).alias("k"), F.col(f"n{i}").alias("seeds")) for i in kinds])))
    seeded = stored(per.filter("seeds > 0"))
    open_ = stored(edges.filter("seed is null").join(seeded.select("pattern").distinct(), "pattern", "left_semi").select("pattern", "value"))
    trusted = spark.createDataFrame([], "pattern string, k int, confidence double")
    before, n = None, 0
    while rounds is None or n < rounds:
        # of each unknown value the trusted patterns it stands in; those beside the pattern itself speak for it
        held = open_.join(trusted, "pattern").groupBy("value", "k").agg(F.count("*").alias("in"))
        gained = open_.join(held, "value").join(trusted.select("pattern", "k", F.lit(1).alias("own")), ["pattern", "k"], "left")
        gained = gained.groupBy("pattern", "k").agg(F.count_if(F.col("in") > F.coalesce("own", F.lit(0))).alias("gained"))
        scored = seeded.join(gained, ["pattern", "k"], "left").withColumn("for", F.col("seeds") + F.coalesce("gained", F.lit(0)))
        unknown = F.col("n") - F.col("known") - F.coalesce("gained", F.lit(0))
        confidence = F.col("for") / (F.col("for") + F.col("known") - F.col("seeds") + UNKNOWN * unknown + 1)
        now = stored(scored.select("pattern", "k", "for", confidence.alias("confidence")).filter((F.col("for") >= min_seeds) & (F.col("confidence") >= min_confidence)).select("pattern", "k", "confidence"))
        count = now.count()
        if before is not None:
            discard(trusted)
        grown = count > (before or 0)
        trusted, before, n = now, count, n + 1
        if not grown:
            break
    # of a candidate's kinds the surest counts; a shape is of its own kind only
    hits = seen.filter("k is null").join(trusted.withColumnRenamed("k", "kind"), "pattern").filter("seed is null or seed = kind")
    hits = hits.groupBy("key", "s", "e").agg(F.max(F.struct("confidence", -F.col("kind"))).alias("x"))
    hits = hits.select("key", F.struct("s", (-F.col("x.col2")).cast("int").alias("k"), "e").alias("span"))
    found = stored(hits.groupBy("key").agg(F.collect_list("span").alias("found")))
    for x in (seen, seeded, open_, *([trusted] if before is not None else [])):
        discard(x)
    return found


def _joined(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (with _key and base) with a column `spans`: the base and the discovered ones."""
    if not found.limit(1).count():
        return rows.withColumn("spans", F.col("base")).drop("_key")
    rows = rows.join(found.withColumnRenamed("key", "_key"), "_key", "left")
    return rows.withColumn("spans", F.expr("array_sort(concat(base, coalesce(found, array())))")).drop("_key", "found")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, base, spans), one row per row of docs; arrays of (s, k, e): start, number in KINDS, end."""
    scanned = stored(scan(docs, id_col, text_col))
    return _joined(scanned.select("id", "_key", "base"), discover(scanned, **options)).withColumnRenamed("id", id_col)


def _listed(spans: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS + MORE) + ")"
    return f"array_join(transform({spans}, x -> concat({names}[x.k], ':', x.s, ':', x.e)), ',')"


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with every span of the text replaced by its kind in square brackets; overlapping spans are replaced together, under the first's kind."""
    names = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS + MORE) + ")"
    scanned = stored(scan(docs, id_col, text_col))
    found = discover(scanned, **options)
    discard(scanned)
    # the columns travel as one, so none of their names can clash
    rows = docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("_t"), _key(F.col(id_col), F.col(text_col)).alias("_key"))
    rows = _joined(base_spans(rows, F.col("_t")).drop("_text").withColumnRenamed("_base", "base"), found)
    step = f"if(x.s < acc.at, struct(acc.out as out, greatest(acc.at, x.e) as at), struct(concat(acc.out, substring(_t, acc.at + 1, x.s - acc.at), {names}[x.k]) as out, x.e as at))"
    done = f"aggregate(spans, struct('' as out, 0 as at), (acc, x) -> {step}, acc -> concat(acc.out, substring(_t, acc.at + 1)))"
    text = F.expr(f"if(size(spans) > 0, {done}, _t)")
    return rows.select(*[text.alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns])


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = {i})) as long)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(F.expr(_listed("base")), 256).alias("base_sha256"), F.expr(_listed("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
