"""Registered queries of the numbered operators; each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm.textbatch import table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm import bpe

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import toxicity

    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_multi_index_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import ann

    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import jaccard

    return jaccard.groups(table(spark, sf_dir, "documents"), count_links=False).select("doc_id", "n_shingles", "component_id", "class_id")


def op4_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same join with the number of links of each document's class, which the SQL of op4_jaccard_join leaves out."""
    from tessera.llm import jaccard

    return jaccard.groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


def op5_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm import sstable

    shards = sstable.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return sstable.read(spark, shards).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import substring

    cut, whole = substring.deduplicate(table(spark, sf_dir, "documents"))
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    return cut.withColumn("kept_sha256", F.sha2(F.col("kept").cast("binary"), 256)).select(columns).unionByName(whole.select(columns))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import quality

    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_exact_mips(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import mips

    return mips.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import mixing

    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm import secret_scan

    return secret_scan.scan(table(spark, sf_dir, "documents"), vocabulary=public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import line_dedup

    cut, whole = line_dedup.deduplicate(table(spark, sf_dir, "documents"))
    columns = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    return cut.withColumn("kept_sha256", F.sha2(F.col("kept").cast("binary"), 256)).select(columns).unionByName(whole.select(columns))


def _rebuilt(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(turns, members) of the rebuilt conversations: the first turns of another one stand before their own later ones."""
    from tessera.llm import prefix_trie

    own = prefix_trie.number(table(spark, sf_dir, "conversations"))
    head, base = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6, F.col("conv_id") - F.col("conv_id") % 100
    members = own.select("conv_id").distinct()
    heads = own.where("conv_id % 100 = 0 and pos <= 5").select(F.col("conv_id").alias("base"), "pos", "role", "text")
    given = members.select("conv_id", head.alias("h"), base.alias("base")).join(heads, "base").where("pos <= h").select("conv_id", "pos", "role", "text")
    lengths = heads.groupBy("base").agg(F.count("*").alias("n"))
    later = own.withColumn("h", head).where("pos > h").withColumn("base", base).join(lengths, "base", "left")
    later = later.select("conv_id", (F.col("pos") - F.col("h") + F.least("h", F.coalesce("n", F.lit(0)))).alias("pos"), "role", "text")
    return later.unionByName(given), members


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import prefix_trie

    return prefix_trie.trie(*_rebuilt(spark, sf_dir))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import collocations

    return collocations.top(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_toxicity": op2_toxicity,
    "op3_multi_index_ann": op3_multi_index_ann,
    "op4_jaccard_join": op4_jaccard_join,
    "op4_jaccard_links": op4_jaccard_links,
    "op5_sstable": op5_sstable,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_quality": op7_quality,
    "op8_exact_mips": op8_exact_mips,
    "op9_mixing": op9_mixing,
    "op10_secrets": op10_secrets,
    "op11_line_dedup": op11_line_dedup,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_collocations": op13_collocations,
}

_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP4 = f"""WITH RECURSIVE words AS (SELECT doc_id, {_WORDS.format(_LOW)} AS w FROM documents),
sh AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
one AS (SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), '|')) AS k, s FROM sh),
cls AS (SELECT doc_id, n, CASE WHEN n = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY n, k) END AS class_id, s FROM one),
rep AS (SELECT doc_id, n, unnest(s) AS x FROM cls WHERE doc_id = class_id AND n > 0),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM rep a JOIN rep b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS d, doc_id AS r FROM cls WHERE doc_id = class_id UNION SELECT link.b, reach.r FROM reach JOIN link ON link.a = reach.d),
comp AS (SELECT d, min(r) AS component_id FROM reach GROUP BY d)
SELECT doc_id, n AS n_shingles, component_id, class_id FROM cls JOIN comp ON comp.d = class_id"""

_OP4_LINKS = _OP4.replace("comp AS (", "deg AS (SELECT a, count(*) AS n_links FROM link GROUP BY a),\ncomp AS (").replace("component_id, class_id FROM cls", "component_id, class_id, coalesce(n_links, 0) AS n_links FROM cls") + " LEFT JOIN deg ON deg.a = class_id"

_OP6 = f"""WITH words AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM words WHERE len(w) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM win),
bad AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first_doc FROM h) WHERE first_doc < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM bad),
each AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS x FROM words),
kept AS (SELECT e.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY e.j) AS t FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.j = e.j WHERE g.j IS NULL GROUP BY e.doc_id)
SELECT w.doc_id, len(w.w) AS n_words, len(w.w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM words w LEFT JOIN kept k ON k.doc_id = w.doc_id"""

_OP8 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)) WHERE rank <= 5"""

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_OP11 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
keyed AS (SELECT r, doc_id, l, list_transform(l, lambda x: translate(trim(x, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS k FROM d),
hot AS (SELECT h FROM (SELECT r, unnest(list_distinct(k)) AS h FROM keyed) WHERE h <> '' GROUP BY h HAVING count(*) >= 10),
each AS (SELECT r, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS x, unnest(k) AS y FROM keyed),
kept AS (SELECT r, count(*) AS n, string_agg(x, chr(10) ORDER BY i) AS t FROM each LEFT JOIN hot ON hot.h = y WHERE hot.h IS NULL GROUP BY r)
SELECT doc_id, len(l) AS n_lines, len(l) - coalesce(n, 0) AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256 FROM keyed LEFT JOIN kept USING (r)"""

# A prefix is told by the texts of its turns, each with its length; the least member stands for a node below.
_OP12 = """WITH RECURSIVE crc AS (SELECT list(list_reduce(range(8), lambda a, s: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END, i) ORDER BY i) AS tab FROM range(256) r(i)),
own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
conv AS (SELECT conv_id, conv_id - conv_id % 100 AS base, n, xor(list_reduce(list_transform(range(1, length(s) + 1), lambda i: ascii(s[i])), lambda a, c: xor(a >> 8, tab[xor(a & 255, c) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 6 AS h
  FROM (SELECT conv_id, count(*) AS n, CAST(conv_id AS VARCHAR) AS s FROM own GROUP BY conv_id), crc),
full_ AS (SELECT c.conv_id, o.pos, role, text FROM conv c JOIN own o ON o.conv_id = c.base AND o.pos <= c.h
  UNION ALL SELECT c.conv_id, o.pos - c.h + least(c.h, coalesce(b.n, 0)), role, text FROM conv c JOIN own o ON o.conv_id = c.conv_id AND o.pos > c.h LEFT JOIN conv b ON b.conv_id = c.base),
pre AS (SELECT conv_id, pos AS d, length(text) AS chars, string_agg(length(role) || ':' || length(text) || ':' || role || text, '' ) OVER (PARTITION BY conv_id ORDER BY pos) AS p FROM full_
  UNION ALL SELECT conv_id, 0, 0, '' FROM conv),
path AS (SELECT conv_id, d, chars, p, min(conv_id) OVER w AS owner, count(*) OVER w AS n, d = max(d) OVER (PARTITION BY conv_id) AS last FROM pre WINDOW w AS (PARTITION BY d, p)),
ends AS (SELECT owner, d, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS e FROM path WHERE last GROUP BY owner, d),
node AS (SELECT a.owner AS conv_id, a.d, a.n, a.chars, b.owner AS parent FROM path a LEFT JOIN path b ON b.conv_id = a.conv_id AND b.d = a.d - 1 WHERE a.owner = a.conv_id),
kids AS (SELECT parent, d - 1 AS d, count(*) AS k FROM node WHERE d > 0 GROUP BY parent, d),
tree AS (SELECT u.owner AS conv_id, u.d, sum(CASE WHEN k.k IS NULL THEN 1 ELSE 0 END) AS leaves, sum((x.n - 1) * x.chars) AS saved FROM node x JOIN path u ON u.conv_id = x.conv_id AND u.d <= x.d LEFT JOIN kids k ON k.parent = x.conv_id AND k.d = x.d GROUP BY u.owner, u.d)
SELECT node.conv_id, node.d AS depth, node.parent AS parent_conv_id, node.n AS n_convs, coalesce(kids.k, 0) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(e, '')) AS ends_sha256
FROM node JOIN tree USING (conv_id, d) LEFT JOIN kids ON kids.parent = node.conv_id AND kids.d = node.d LEFT JOIN ends ON ends.owner = node.conv_id AND ends.d = node.d"""

_OP13 = f"""WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOW}, '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM piece),
g AS (SELECT lang, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS p FROM w, (VALUES (1), (2), (3), (4)) s(k) WHERE len(w) >= k),
f AS (SELECT lang, p, count(*) AS a FROM g GROUP BY lang, p),
cand AS (SELECT * FROM f WHERE len(p) > 1 AND a >= 30),
cut AS (SELECT c.lang, c.p, c.a, c.k, x.a AS l, y.a AS r, CAST(2000000::HUGEINT * c.a // (x.a + y.a) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, len(p))) AS k FROM cand) c JOIN f x ON x.lang = c.lang AND x.p = c.p[1:c.k] JOIN f y ON y.lang = c.lang AND y.p = c.p[c.k + 1:]),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS i FROM cut) WHERE i = 1),
held AS (SELECT lang, p[i:i + n - 1] AS p, max(a) AS longer FROM (SELECT *, unnest(range(1, len(p) - n + 2)) AS i FROM cand, (VALUES (2), (3)) s(n) WHERE n < len(p)) GROUP BY 1, 2),
kept AS (SELECT b.*, array_to_string(b.p, ' ') AS phrase FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.p = b.p WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * b.a),
total AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang)
SELECT * FROM (SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM kept JOIN total ON total.lang = kept.lang) WHERE rank <= 2000"""

#: DuckDB SQL of those that SQL can express on whole tables; the tests hold the others against brute force.
ORACLE_SQL: dict[str, str] = {"op4_jaccard_join": _OP4, "op4_jaccard_links": _OP4_LINKS, "op6_substring_dedup": _OP6, "op8_exact_mips": _OP8, "op11_line_dedup": _OP11, "op12_prefix_trie": _OP12, "op13_collocations": _OP13}
