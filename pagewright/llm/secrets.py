"""Secret scan with multipart credential linking, in built-in functions only.

Patterns find three kinds of strong spans (an assignment to a secret's name, an
access key id, a long hexadecimal run) and three kinds of weak ones (a login
name, an opaque token, an endpoint).  Strong spans are always reported.  The
parts of a text are then interval-joined: an identifier and a secret belong
together where their starts are at most ``SCOPE`` code points apart, an endpoint
belongs to an identifier with a secret likewise.  Weak spans are reported only
where such complementary parts co-occur, and never where they overlap a strong
one.

Offsets are code points, end exclusive.  They come from the lengths of the
matches and of what is between them, because the engine's own match positions
count UTF-16 units.  The interval join is an equi-join on (text, bin of SCOPE
code points): a bin holds a bounded number of parts however long the text.

Defined cases: a null text is an empty one and has no spans; documents with an
equal text have equal spans, whatever their ids, and repeated rows stay rows of
their own; spans that begin together are ordered by kind; a very long text is
scanned whole, in one row; other columns are ignored, whatever they are called;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents_only, materialize

SCOPE = 256


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _names(*words: str) -> str:
    return "(" + "|".join(map(either_case, words)) + ")"


_SET = r"""["']?\x20*[:=]\x20*["']?"""
_PLACE = "([A-Za-z0-9._~:/?#@!$&()*+,;=%-]+)"
#: kind, rank, role, strong, pattern, group whose length counts, least length.
KINDS = (
    ("assign", 0, "secret", True, "(" + "|".join((*map(either_case, ("password", "passwd", "secret", "token")), either_case("api") + "_?" + either_case("key"))) + ")" + _SET + "([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", 1, "id", True, "(AKIA[A-Z0-9]{16,})", 1, 20),
    ("hex", 2, "secret", True, "([0-9a-f]{24,})", 1, 24),
    ("login", 3, "id", False, _names("user", "username", "login", "account", "client_id", "key_id") + _SET + "([A-Za-z0-9@._-]+)", 2, 3),
    ("opaque", 4, "secret", False, "([A-Za-z0-9+/]{32,})", 1, 32),
    ("endpoint", 5, "endpoint", False, r"(https?://|(?:" + _names("host", "endpoint", "server")[1:-1] + ")" + _SET + r")" + _PLACE, 2, 3),
)
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def spans(text: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """The spans of one pattern, leftmost and non-overlapping; too short ones drop out after matching."""
    whole, part = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    if kind == "opaque":
        good = lambda p: p.rlike("[0-9]") & p.rlike("[A-Z]") & p.rlike("[a-z]")
    else:
        good = lambda p: F.length(p) >= least
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("found"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gaps"])
        end = start + F.length(x["whole"])
        one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind")))
        return F.struct(end.alias("at"), F.when(good(x["part"]), F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    zipped = F.arrays_zip(whole.alias("whole"), part.alias("part"), F.slice(gaps, 1, F.size(whole)).alias("gaps"))
    return F.when(text.rlike(pattern), F.aggregate(zipped, zero, step, lambda acc: acc["found"])).otherwise(F.array().cast(_SPAN))


def _as_text(found: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(found), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (of the text), strong, weak: arrays of spans of each document."""
    docs = documents_only(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    of = {kind: spans(F.col("text"), kind, rank, pattern, group, least) for kind, rank, _, _, pattern, group, least in KINDS}
    strong = F.concat(*(of[k] for k, _, _, s, *_ in KINDS if s))
    weak = F.concat(*(of[k] for k, _, _, s, *_ in KINDS if not s))
    out = docs.select("doc_id", F.sha2("text", 256).alias("key"), strong.alias("strong"), weak.alias("weak"))
    clear = F.filter("weak", lambda w: ~F.exists("strong", lambda s: (w["start"] < s["end"]) & (s["start"] < w["end"])))
    return out.withColumn("weak", clear)


def _near(left: DataFrame, right: DataFrame, scope: int) -> DataFrame:
    """Pairs of spans a (left) and b (right) of one text whose starts are at most ``scope`` apart."""
    bin_ = lambda c: F.floor(F.col(c)["start"] / scope).cast("int")
    left = left.withColumn("bin", F.explode(F.array(bin_("a") - 1, bin_("a"), bin_("a") + 1)))
    return left.join(right.withColumn("bin", bin_("b")), ["key", "bin"]).where(F.abs(F.col("a.start") - F.col("b.start")) <= scope).drop("bin")


def credentials(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """key, a, b, c: an identifier's span, a secret's near it, and an endpoint's near the identifier or null.

    ``found`` is what ``scan`` gives; each distinct text is joined once.
    """
    role = F.create_map(*(F.lit(x) for k, _, r, *_ in KINDS for x in (k, r)))
    # a text without an identifier or without a secret can't link anything
    has = lambda r: F.exists(F.concat("strong", "weak"), lambda x: role[x["kind"]] == r)
    some = found.where(has("id") & has("secret")).dropDuplicates(["key"])
    parts = some.select("key", F.explode(F.concat("strong", "weak")).alias("x")).withColumn("role", role[F.col("x.kind")])
    of = lambda r, name: parts.where(F.col("role") == r).select("key", F.col("x").alias(name))
    pairs = _near(of("id", "a"), of("secret", "b"), scope)
    ends = _near(pairs.select("key", "a").distinct(), of("endpoint", "b"), scope).withColumnRenamed("b", "c")
    return pairs.join(ends, ["key", "a"], "left").select("key", "a", "b", "c")


def op4_credential_links(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for all documents."""
    found = materialize(scan(spark.read.parquet(f"{sf_dir}/documents.parquet")), "spans")
    weak = F.array(*(F.lit(k) for k, _, _, s, *_ in KINDS if not s))
    linked = credentials(found).select("key", F.explode(F.array("a", "b", "c")).alias("x")).where(F.col("x").isNotNull() & F.array_contains(weak, F.col("x.kind")))
    # written, so that both sides of the join are dealt for it alone and a text with many copies can be split
    extra = materialize(linked.groupBy("key").agg(F.collect_set("x").alias("extra")), "linked")
    out = found.drop("weak").join(extra, "key", "left")
    count = lambda k: F.size(F.filter("strong", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    every = F.concat("strong", F.coalesce("extra", F.array().cast(_SPAN)))
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_as_text(F.col("strong")), 256).alias("base_sha256"), _as_text(every).alias("spans"))


def _sql() -> str:
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    parts = []
    for kind, rank, role, strong, pattern, group, least in KINDS:
        good = "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]')" if kind == "opaque" else f"length(v) >= {least}"
        p = quote(pattern)
        parts.append(f"""
SELECT doc_id, '{kind}' AS kind, {rank} AS rank, '{role}' AS role, {str(strong).lower()} AS strong, e - length(m) AS s, e FROM (
  SELECT doc_id, m, v, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
    SELECT doc_id, unnest(regexp_extract_all(text, {p})) AS m, unnest(regexp_extract_all(text, {p}, {group})) AS v,
      unnest(string_split_regex(text, {p})[:len(regexp_extract_all(text, {p}))]) AS g, generate_subscripts(regexp_extract_all(text, {p}), 1) AS i
    FROM d WHERE regexp_matches(text, {p}))) WHERE {good}""")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
x0 AS ({" UNION ALL ".join(parts)}),
x AS (SELECT * FROM x0 a WHERE strong OR NOT EXISTS (SELECT 1 FROM x0 b WHERE b.strong AND b.doc_id = a.doc_id AND a.s < b.e AND b.s < a.e)),
p AS (SELECT a.doc_id, a.kind AS ak, a.s AS asx, a.e AS ae, b.kind AS bk, b.s AS bs, b.e AS be FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.role = 'id' AND b.role = 'secret' AND abs(a.s - b.s) <= {SCOPE}),
w AS (SELECT doc_id, ak AS kind, asx AS s, ae AS e FROM p UNION SELECT doc_id, bk, bs, be FROM p
  UNION SELECT p.doc_id, c.kind, c.s, c.e FROM p JOIN x c ON c.doc_id = p.doc_id AND c.role = 'endpoint' AND abs(p.asx - c.s) <= {SCOPE}),
r AS (SELECT x.* FROM x WHERE strong UNION ALL SELECT x.* FROM x JOIN w USING (doc_id, kind, s, e) WHERE NOT strong),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (strong), '') AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""


OP4_SQL = _sql()
