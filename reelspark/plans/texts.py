"""String queries over documents, pages, parts and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.functions import numbers as N
from reelspark.functions import strings as S
from reelspark.operators import windows
from reelspark.plans.registry import query


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'), '^ ', '') AS text FROM documents")
def collapse_ws(t):
    return t.documents.select("doc_id", S.collapse_spaces(F.col("text")).alias("text"))


@query("SELECT doc_id, substring(text, 1, 19) AS line1, substring(text, 20, 19) AS line2, length(text) > 38 AS truncated FROM documents")
def text_preview(t):
    return t.documents.select("doc_id", S.preview(F.col("text")).alias("p")).select("doc_id", "p.*")


_DATED = "concat('Reel ', cast(p_size * 97 AS {s}), ' of ', cast(1790 + p_partkey % 300 AS {s}), '-', cast(p_partkey % 12 AS {s}))"


@query(f"SELECT p_partkey, nullif(regexp_extract({_DATED.format(s='VARCHAR')}, '(1[89][0-9][0-9]|20[0-9][0-9])', 1), '')::BIGINT AS year FROM part")
def year_extract(t):
    return t.part.select("p_partkey", S.year(F.expr(_DATED.format(s="STRING"))).alias("year"))


_EPISODE = """CASE p_partkey % 6 WHEN 0 THEN concat(replace(p_name, ' ', '.'), '.S', lpad(cast(p_size AS {s}), 2, '0'), 'E', cast(p_partkey % 1000 AS {s}), '.1080p.vid')
 WHEN 1 THEN concat(p_name, ' - s', cast(p_size AS {s}), 'e', cast(p_partkey % 99 AS {s}), ' - Title') WHEN 2 THEN concat('S01E', cast(p_size AS {s})) WHEN 3 THEN concat(p_name, '.1920x1080')
 WHEN 4 THEN concat('_x_', p_name, '__S', cast(p_size AS {s}), 'E1 S2E', cast(p_size AS {s})) ELSE concat(p_name, ' SxE') END"""


@query(rf"""
WITH x AS (SELECT p_partkey, {_EPISODE.format(s="VARCHAR")} AS file FROM part),
     y AS (SELECT *, regexp_extract(file, '^(.*?)[sS]([0-9]{{1,4}})[eE]([0-9]{{1,4}})', ['n', 's', 'e']) AS p FROM x), z AS (SELECT *, rtrim(p.n, ' .-_') AS name FROM y)
SELECT p_partkey, file, CASE WHEN p.s <> '' AND name <> '' THEN translate(name, '._', '  ') END AS series, CASE WHEN p.s <> '' AND name <> '' THEN try_cast(p.s AS BIGINT) END AS season,
       CASE WHEN p.s <> '' AND name <> '' THEN try_cast(p.e AS BIGINT) END AS episode FROM z""")
def series_parse(t):
    rows = t.part.select("p_partkey", F.expr(_EPISODE.format(s="STRING")).alias("file")).withColumn("s", S.series(F.col("file")))
    return rows.select("p_partkey", "file", "s.series", "s.season", "s.episode")


@query("SELECT page_id, substring(regexp_replace(html, '<[^>]*>|<[^>]*$|>', '', 'g'), 1, 192) AS text FROM pages")
def strip_tags(t):
    return t.pages.select("page_id", S.strip_tags(F.col("html")).alias("text"))


@query(r"""
WITH x AS (SELECT doc_id, n_chars, substring(trim(translate(concat('  ', text, '|x'), '|' || chr(13) || chr(10), '/  '), ' '), 1, 39) AS label FROM documents)
SELECT doc_id, label, printf('%d.%03d|', n_chars // 1000, n_chars % 1000) || label AS line FROM x""")
def sanitize_label(t):
    label = S.label(F.concat(F.lit("  "), F.col("text"), F.lit("|x")))
    clock = F.concat(N.div(F.col("n_chars"), 1000).cast("string"), F.lit("."), F.lpad((F.col("n_chars") % 1000).cast("string"), 3, "0"), F.lit("|"))
    return t.documents.select("doc_id", label.alias("label"), F.concat(clock, label).alias("line"))


_TRIPLE = "concat(cast(p_size * 6 AS {s}), CASE WHEN p_partkey % 5 = 0 THEN ';' ELSE ',' END, ' ', cast(p_partkey % 256 AS {s}), ',', cast(p_size AS {s}))"


@query(f"""
WITH x AS (SELECT p_partkey, {_TRIPLE.format(s="VARCHAR")} AS t FROM part), y AS (SELECT *, regexp_extract(t, '^ *(-?[0-9]+) *, *(-?[0-9]+) *, *(-?[0-9]+) *$', ['a', 'b', 'c']) AS p FROM x)
SELECT p_partkey, CASE WHEN p.a <> '' AND try_cast(p.a AS INT) BETWEEN 0 AND 255 AND try_cast(p.b AS INT) BETWEEN 0 AND 255 AND try_cast(p.c AS INT) BETWEEN 0 AND 255 THEN try_cast(p.a AS BIGINT) * 65536 + try_cast(p.b AS BIGINT) * 256 + try_cast(p.c AS BIGINT) END AS colour FROM y""")
def triplet_parse(t):
    rows = t.part.select("p_partkey", S.triplet(F.expr(_TRIPLE.format(s="STRING")), 0, 255).alias("c"))
    return rows.select("p_partkey", (F.col("c")[0].cast("long") * 65536 + F.col("c")[1] * 256 + F.col("c")[2]).alias("colour"))


@query(r"SELECT page_id, string_split(url, '/')[-1] AS base, regexp_replace(url, '\.[^./]*$', '') || '.srt' AS sidecar FROM pages")
def path_rewrite(t):
    return t.pages.select("page_id", S.basename(F.col("url")).alias("base"), S.with_extension(F.col("url"), ".srt").alias("sidecar"))


@query("SELECT c_custkey, concat_ws(' - ', CASE WHEN c_nationkey > 4 THEN c_name END, CASE WHEN c_acctbal > 0 THEN c_mktsegment END, cast(c_nationkey AS VARCHAR)) AS summary FROM customer")
def concat_skip_null(t):
    return t.customer.select("c_custkey", F.concat_ws(" - ", F.when(F.col("c_nationkey") > 4, F.col("c_name")), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")), F.col("c_nationkey").cast("string")).alias("summary"))


@query("""
WITH x AS (SELECT s_suppkey, s_nationkey, 'Reel ' || (s_suppkey * 37 % 1000)::VARCHAR || ' part ' || s_suppkey::VARCHAR AS name, s_suppkey * 37 % 1000 AS a FROM supplier)
SELECT s_suppkey, name, row_number() OVER (PARTITION BY s_nationkey ORDER BY a, s_suppkey) AS place FROM x""")
def natural_sort(t):
    """Names in the order in which numbers in them count as numbers."""
    k = F.col("s_suppkey")
    rows = t.supplier.select("s_suppkey", "s_nationkey", F.concat(F.lit("Reel "), (k * 37 % 1000).cast("string"), F.lit(" part "), k.cast("string")).alias("name"))
    first = F.regexp_extract("name", r"(\d+)", 1).cast("long")  # names are equal up to their first number
    return windows.numbered(rows, ["s_nationkey"], [S.natural_key(F.col("name"))], first, "place").select("s_suppkey", "name", "place")


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def sha256_hash(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("digest"))


@query("""
WITH t AS (SELECT list(v ORDER BY n) AS tab FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda a, i: xor(a >> 1, 3988292384 * (a & 1))) AS v FROM range(256) r(n))),
     d AS (SELECT doc_id, string_split(regexp_replace(hex(encode(text)), '(..)', '\\1 ', 'g'), ' ') AS h FROM documents)
SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || x)::BIGINT FOR x IN h IF x <> '']), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) AS crc FROM d, t""")
def crc32_hash(t):
    return t.documents.select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc"))


@query("""
WITH x AS (SELECT page_id, url, list_reduce(list_prepend(2166136261::BIGINT, [ord(c)::BIGINT FOR c IN string_split(url, '')]), lambda h, b: (xor(h, b) * 16777619) & 4294967295) AS h FROM pages)
SELECT page_id, h AS fnv, 'state.' || string_split(url, '/')[-1] || '.' || lpad(lower(to_hex(h)), 8, '0') || '.bm' AS identity FROM x""")
def fnv1a(t):
    h = N.fnv1a(F.col("url"))
    name = F.concat(F.lit("state."), S.basename(F.col("url")), F.lit("."), F.lower(F.lpad(F.hex(h), 8, "0")), F.lit(".bm"))
    return t.pages.select("page_id", h.alias("fnv"), name.alias("identity"))
