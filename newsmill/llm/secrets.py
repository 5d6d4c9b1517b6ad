"""Secret scan with multipart credential linking, in DataFrame functions only.

Three base kinds are found by pattern, leftmost and without overlap: ``assign`` (``password = ...``), ``access`` (``AKIA...``)
and ``hex`` (24 or more hexadecimal digits). Weak candidates (client identifiers, bare high-variety secrets, service
endpoints) say little alone; one is reported only when a complementary part lies at most ``scope`` code points away. That is an
interval join within the document: parts are sorted and indexed by blocks with bounds, and a part looks only into blocks in reach.
A text with n matches costs about n times the square root of n, so very long texts with very many matches are no trouble.

Rules for odd input: a null text is an empty one and gives zeros, the digest of the empty string and an empty ``spans``;
repeated rows give repeated rows; ties in ``start`` go by kind in the order of ``KINDS``; other columns of the input, of any
name, stay in the struct ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# Weak parts, our own. A bare secret has any length from 20 on and may end in base64 padding.
CLIENT = r"(?i:client_?id|account_?id|user_?name|login)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{4,}"
BARE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[a-z])(?=[A-Za-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])"
ENDPOINT = r"(?:https?|ftp|ssh|jdbc:[a-z]+|postgres|mysql|redis|mongodb|amqp)://[^\s\"'<>]+"
CLIENT_HINTS = ("clientid", "client_id", "accountid", "account_id", "username", "user_name", "login")

KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "weak_endpoint")
SPAN = "array<struct<start:int,kind:int,end:int>>"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _cut(items: Column, kind: str) -> Column:
    """An array as consecutive blocks of about the square root of its size: work within blocks and over blocks stays far from quadratic."""

    def blocks(a: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(a))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(a) / size).cast("int") - 1), lambda i: F.slice(a, i * size + 1, size))

    return _let(items, lambda a: F.when(F.size(a) > 0, blocks(a)).otherwise(F.array().cast(f"array<{kind}>")))


def _prefix(values: Column, add) -> Column:
    """0 and then the running ``add`` of an array of integers."""
    return F.aggregate(values, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(add(F.element_at(acc, -1), x))))


def _running(values: Column, add) -> Column:
    """The running ``add`` of an array of integers from 0 on, block by block."""
    inner = F.transform(_cut(values, "array<int>"), lambda b: F.slice(_prefix(b, add), F.lit(2), F.size(b)))
    ends = lambda blocks: _prefix(F.transform(blocks, lambda b: F.element_at(b, -1)), add)
    return _let(inner, lambda blocks: F.flatten(F.zip_with(blocks, F.slice(ends(blocks), F.lit(1), F.size(blocks)), lambda b, at: F.transform(b, lambda x: add(x, at)))))


def _spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Matches as (start, kind, end): running sums over the pieces between matches and the matches' lengths give the offsets."""

    def place(found: Column) -> Column:
        gaps = F.slice(F.transform(F.split(text, pattern, -1), lambda p: F.length(p)), F.lit(1), F.size(found))
        ends = _running(F.zip_with(gaps, found, lambda gap, m: gap + F.length(m)), lambda x, y: x + y)
        spans = F.zip_with(ends, found, lambda end, m: F.struct((end - F.length(m)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), m.alias("m")))
        if keep is not None:
            spans = F.filter(spans, lambda s: keep(s["m"]))
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


def _where(hint: Column, spans: Column) -> Column:
    """Spans only where a cheap substring test says that the pattern can occur."""
    return F.coalesce(F.when(hint, spans), F.array().cast(SPAN))


def _any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def _reached(parts: Column, others: Column, reach: int, wanted: bool = True) -> Column:
    """Interval join within the row: those of ``parts`` that do (or don't) have one of ``others`` at most ``reach`` code points away.

    The others are sorted and cut into blocks with their bounds; a part looks into the blocks whose bounds it can reach.
    """

    def bounds(b: Column) -> Column:
        return F.struct(b[0]["start"].alias("low"), F.array_max(F.transform(b, lambda o: o["end"])).alias("high"), b.alias("items"))

    def near(p: Column, blocks: Column) -> Column:
        inside = lambda low, high: (low <= p["end"] + reach) & (high >= p["start"] - reach)
        return F.exists(blocks, lambda b: inside(b["low"], b["high"]) & F.exists(b["items"], lambda o: inside(o["start"], o["end"])))

    indexed = F.transform(_cut(F.sort_array(others), SPAN), bounds)
    return _let(indexed, lambda blocks: F.filter(parts, lambda p: near(p, blocks) if wanted else ~near(p, blocks)))


def _near(parts: Column, others: Column, scope: int) -> Column:
    return _reached(parts, others, scope)


def _free(parts: Column, taken: Column) -> Column:
    """Those of ``parts`` that share no code point with one of ``taken``."""
    return _reached(parts, taken, -1, wanted=False)


def _join(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def scan(docs: DataFrame, text: str = "text", scope: int = 200) -> DataFrame:
    """One row per row of ``docs``: ``row`` (the whole input row as a struct, so no column name can clash), ``text`` (null as
    empty), the arrays ``assign``, ``access``, ``hex``, ``base`` and ``spans`` of (start, kind, end); the last two ordered by
    start and then kind.

    All work stays in the row, so a document of any length or a source of any size needs no shuffle. Each step is a column of
    its own and no struct, since the optimiser would repeat a struct's fields for every use.
    """
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    x, low = F.col("text"), F.col("low")
    df = df.withColumn("low", F.lower(x))
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 6
    df = (
        df.withColumn("assign", _where(_any(low, ASSIGN_HINTS), _spans(x, ASSIGN, 0, value)))
        .withColumn("access", _where(x.contains("AKIA"), _spans(x, ACCESS, 1)))
        .withColumn("hex", _where(x.rlike(HEX), _spans(x, HEX, 2)))
        .withColumn("clients", _where(_any(low, CLIENT_HINTS), _spans(x, CLIENT, 3)))
        .withColumn("ends", _where(x.contains("://"), _spans(x, ENDPOINT, 5)))
    )
    df = df.withColumn("base", F.sort_array(F.concat("assign", "access", "hex")))
    # A bare secret matters only beside an identifier or endpoint: documents without one are not searched.
    beside = (F.size("access") > 0) | (F.size("clients") > 0) | (F.size("ends") > 0)
    df = df.withColumn("bare", _free(_where(beside, _spans(x, BARE, 4)), F.col("base")))
    secrets = F.concat("assign", "hex", "bare")
    others = F.concat("access", "clients", "ends")
    df = df.withColumn(
        "spans",
        F.sort_array(
            F.concat(
                F.col("base"),
                _near(F.col("bare"), others, scope),
                _near(_free(F.col("clients"), F.col("base")), secrets, scope),
                _near(_free(F.col("ends"), F.col("base")), secrets, scope),
            )
        ),
    )
    return df.select("row", "text", "assign", "access", "hex", "base", "spans")


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of the scan, a row per document."""
    return scan(docs).select(
        F.col("row")["doc_id"].alias("doc_id"),
        F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"),
        F.sha2(_join(F.col("base")), 256).alias("base_sha256"),
        _join(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every reported span replaced by ``mask`` and ``n_chars`` (where there is one) renewed; all rows stay.

    Overlapping spans are masked once. A null text stays null.
    """
    ends = _running(F.transform("spans", lambda s: s["end"]), lambda x, y: F.greatest(x, y))
    #: Of each span: where the spans before it end, and where it starts; text between the two stays.
    steps = F.zip_with("spans", F.concat(F.array(F.lit(0)), F.slice("ends", F.lit(1), F.size("ends") - 1)), lambda s, at: F.struct(at.alias("at"), s["start"].alias("to")))

    def masked(b: Column) -> Column:  # the block's own text first, since a substring is sought from the text's beginning
        base, most = b[0]["at"], F.array_max(F.transform(b, lambda x: x["to"]))
        own = F.col("text").substr(base + 1, F.greatest(most - base, F.lit(0)))
        one = lambda t, x: F.when(x["to"] >= x["at"], F.concat(t.substr(x["at"] - base + 1, x["to"] - x["at"]), F.lit(mask))).otherwise("")
        return _let(own, lambda t: F.array_join(F.transform(b, lambda x: one(t, x)), ""))

    hit = F.size("spans") > 0
    df = scan(docs).withColumn("ends", F.when(hit, ends)).withColumn("blocks", F.when(hit, _cut(steps, "array<struct<at:int,to:int>>")))
    rest = F.col("text").substr(F.element_at("ends", -1) + 1, F.length("text"))
    df = df.withColumn("new", F.when(hit, F.concat(F.array_join(F.transform("blocks", masked), ""), rest)))
    put = {"text": F.when(hit, F.col("new")).otherwise(F.col("row")["text"])}
    if "n_chars" in docs.columns:
        put["n_chars"] = F.when(hit, F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row")["n_chars"])
    return df.select(*[put.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


# --- the query and its SQL ---------------------------------------------------------------------


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _sql_places(kind: int, pattern: str, keep: str = "true") -> str:
    """Matches of a pattern with their offsets, from the pieces between them."""
    return (
        f"SELECT doc_id, {kind} AS kind, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS a, f[i] AS m, p[i + 1] AS rest, i < len(f) AS more "
        f"FROM (SELECT doc_id, p, f, unnest(range(1, len(f) + 1)) AS i FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS p, regexp_extract_all(t, '{pattern}') AS f FROM d)) WHERE {keep}"
    )


_SQL_ASSIGN = ASSIGN.replace("'", "''")
_SQL_ENDPOINT = ENDPOINT.replace(r"\s", r"\x20\x09-\x0D").replace(r"\"", '"').replace("'", "''")
_SQL_CLIENT = CLIENT.replace(r"\"", '"').replace("'", "''")
_SQL_NAMES = "['" + "', '".join(KINDS) + "']"

#: Every part against every other. A bare secret is a run of its characters, with what follows it looked at in the next piece.
OP10_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (
  {_sql_places(0, _SQL_ASSIGN)} AND length(regexp_extract(f[i], '{_SQL_ASSIGN}', 1)) >= 6
  UNION ALL {_sql_places(1, ACCESS)} UNION ALL {_sql_places(2, HEX)} UNION ALL {_sql_places(3, _SQL_CLIENT)} UNION ALL {_sql_places(5, _SQL_ENDPOINT)}),
runs AS (SELECT *, length(regexp_extract(rest, '^=*')) AS pad FROM ({_sql_places(4, "[A-Za-z0-9+/_-]+")})
  WHERE length(m) >= 20 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]')),
parts AS (SELECT doc_id, kind, a, CAST(a + length(m) AS INTEGER) AS z FROM found
  UNION ALL SELECT doc_id, kind, a, CAST(a + length(m) + pad AS INTEGER) FROM runs WHERE pad <= 2 AND NOT (pad > 0 AND more AND pad = length(rest))),
base AS (SELECT * FROM parts WHERE kind <= 2),
free AS (SELECT * FROM parts p WHERE kind > 2 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = p.doc_id AND b.a < p.z AND p.a < b.z)),
weak AS (
  SELECT * FROM free p WHERE kind = 4 AND EXISTS (SELECT 1 FROM parts o WHERE o.doc_id = p.doc_id AND o.kind IN (1, 3, 5) AND greatest(p.a - o.z, o.a - p.z) <= 200)
  UNION ALL SELECT * FROM free p WHERE kind <> 4 AND (EXISTS (SELECT 1 FROM base o WHERE o.doc_id = p.doc_id AND o.kind <> 1 AND greatest(p.a - o.z, o.a - p.z) <= 200)
    OR EXISTS (SELECT 1 FROM free o WHERE o.doc_id = p.doc_id AND o.kind = 4 AND greatest(p.a - o.z, o.a - p.z) <= 200))),
spans AS (SELECT *, kind <= 2 AS strong, {_SQL_NAMES}[kind + 1] || ':' || a || ':' || z AS s FROM (SELECT * FROM base UNION ALL SELECT * FROM weak))
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg(s, ',' ORDER BY a, kind) FILTER (strong), '')) AS base_sha256, coalesce(string_agg(s, ',' ORDER BY a, kind), '') AS spans
FROM d LEFT JOIN spans ON d.doc_id = spans.doc_id GROUP BY d.doc_id
"""
