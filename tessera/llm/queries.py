"""The queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, decontaminate, language_id, pieces, prefix_trie, quality, secrets, spelling, toxicity, warc
from tessera.llm.exact_dedup import exact_duplicates
from tessera.llm.near_dedup import near_duplicate_classes
from tessera.session import fresh_path, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.fit_on_documents(docs))
    return found.select(
        F.col("id").alias("doc_id"), language_id.held_out("id").alias("held_out"), "lang_pred", "score"
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_on_documents(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        F.col("id").alias("doc_id"),
        toxicity.held_out("id").alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws quality.SHARE of all documents; the target is the labelled text of quality 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # by a merge join whatever the labels' size, so that one plan, and its cost, serves all sizes
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").hint("merge")
    drawn = quality.resampled(docs, docs.join(good, "doc_id", "left_semi"), round(quality.SHARE * docs.count()))
    return drawn.withColumnRenamed("id", "doc_id")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repaired_turns(table(spark, sf_dir, "conversations")).drop("place")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encoded(docs, pieces.load()).drop("text")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"), num=85).drop("text_key")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan_report(docs, secrets.fit(docs))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digested(docs, bpe.load()).drop("text")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = r"""
WITH b AS (
  SELECT item_id, regexp_extract_all(%(lower)s, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), bi AS (
  SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0
), win AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(10, len(w)) AS n, array_to_string(w[i:i + 9], ' ') AS win FROM bi
), lens AS (SELECT DISTINCT n FROM win),
d AS (
  SELECT doc_id, coalesce(regexp_extract_all(%(lower)s, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
nx AS (
  SELECT doc_id, pos, array_agg(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS nx FROM p
), k AS (
  SELECT doc_id, pos, n, array_to_string(nx[1:n], ' ') AS win FROM nx, lens WHERE len(nx) >= n
), h AS (SELECT doc_id, pos, k.n, item FROM k JOIN win ON k.n = win.n AND k.win = win.win),
hw AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS q FROM h) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw ON d.doc_id = hw.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
""" % {"lower": _AZ.format("text")}  # fmt: skip

OP6_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload) AS payload_bytes, unhex(sha1(payload)) AS d, sha256(payload) AS k FROM p),
b AS (
  SELECT page_id, payload_bytes, k,
         array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
           list_sum(list_transform(range(5), lambda j: ((get_bit(CAST(d AS BIT), CAST(i * 5 + j AS INT))) << (4 - j)))) AS INT), 1)), '') AS payload_digest
  FROM h
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id > min(page_id) OVER w THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > min(page_id) OVER w THEN min(page_id) OVER w END AS refers_to
FROM b WINDOW w AS (PARTITION BY k)
"""

OP8_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
), c AS (
  SELECT *, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size,
         row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) AS rn
  FROM t
)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, text_sha256 FROM c
"""

OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(%(lower)s, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), p AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
nx AS (
  SELECT doc_id, n, pos, array_agg(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS nx FROM p
), s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(nx, ' ')) AS sh FROM nx WHERE pos <= greatest(n - 4, 1)
), c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 100 * shared >= 85 * (ca.n + cb.n - shared)
), reach(id, r) AS (
  SELECT a, a FROM links UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.r = links.a
), low AS (SELECT id, min(r) AS component FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, coalesce(least(component, d.doc_id), d.doc_id) AS component_id,
       coalesce(least(component, d.doc_id), d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN low ON low.id = d.doc_id
""" % {"lower": _AZ.format("text")}  # fmt: skip


#: CRC-32 by its bits: a byte goes in, then eight steps follow, marked -1.
_CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(range(octet_length(encode({0}))),
  lambda i: [CAST('0x' || substr(hex(encode({0})), 2 * i + 1, 2) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END))"""
OP11_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, octet_length(encode(coalesce(text, ''))) AS b,
         sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (SELECT conv_id, list({'k': k, 'b': b} ORDER BY turn NULLS FIRST, role, k) AS s FROM t GROUP BY conv_id),
c AS (SELECT conv_id, s, %(crc)s %% 9 AS h FROM (SELECT *, CAST(conv_id AS VARCHAR) AS id FROM own)),
r AS (
  SELECT c.conv_id, list_concat(coalesce(o.s, [])[1:h], c.s[h + 1:]) AS s FROM c LEFT JOIN own o ON o.conv_id = c.conv_id - c.conv_id %% 5
), p AS (
  SELECT conv_id, d, len(s) = d AS ends, s[d].b AS b, sha256(array_to_string(list_transform(s[1:d], lambda x: x.k), ',')) AS p,
         CASE WHEN d > 0 THEN sha256(array_to_string(list_transform(s[1:d - 1], lambda x: x.k), ',')) END AS up
  FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM r)
), n AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(up) AS up, (count(*) - 1) * coalesce(any_value(b), 0) AS saved,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM p GROUP BY p, d
), k AS (SELECT up, count(*) AS n_children FROM n GROUP BY up),
s AS (
  SELECT p.p, count(*) FILTER (WHERE k.up IS NULL) AS n_leaves, sum(saved) AS saved_tokens
  FROM n JOIN p ON p.conv_id = n.conv_id AND p.d <= n.d LEFT JOIN k ON k.up = n.p GROUP BY p.p
)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, a.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN s ON s.p = n.p LEFT JOIN k ON k.up = n.p LEFT JOIN n a ON a.p = n.up
""" % {"crc": _CRC32.format("id")}  # fmt: skip

OP13_SQL = r"""
WITH RECURSIVE r AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(%(lower)s, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents
), d AS (SELECT id, run, count(*) AS n FROM r GROUP BY id, run),
h AS (SELECT run, n, %(crc)s AS h FROM (SELECT run, n, id || ':' || run AS k FROM d)),
o AS (
  SELECT CASE WHEN h %% 97 = 0 THEN substr(run, 1, CAST(h %% length(run) AS INT)) || substr(run, CAST(h %% length(run) AS INT) + 2) ELSE run END AS word, n
  FROM h
), w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM o WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
places AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w),
cut AS (SELECT word, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM places),
same AS (SELECT word, a || '*' || b AS k FROM cut),
p AS (
  SELECT x.word, y.word AS near FROM same x JOIN same y ON x.k = y.k AND x.word <> y.word
  UNION SELECT cut.word, w.word FROM cut JOIN w ON a || b = w.word
  UNION SELECT w.word, cut.word FROM cut JOIN w ON a || b = w.word
), f AS (
  SELECT p.word, w.n, count(*) AS n_near, arg_min(near, (-v.n, near)) AS best, max(v.n) AS best_n
  FROM p JOIN w ON w.word = p.word JOIN w v ON v.word = near GROUP BY p.word, w.n
), g AS (SELECT word, n_near, best AS form, best_n AS form_n, best_n >= 2 * n AS strong FROM f),
step AS (
  SELECT word, form AS root FROM g WHERE strong
  UNION SELECT step.word, g.form FROM step JOIN g ON g.word = step.root AND g.strong
), last AS (SELECT word, root FROM step WHERE root NOT IN (SELECT word FROM g WHERE strong))
SELECT w.word, n, CASE WHEN strong THEN form END AS form, coalesce(root, w.word) AS root, coalesce(n_near, 0) AS n_near,
       CASE WHEN strong THEN form_n END AS form_n
FROM w LEFT JOIN g ON g.word = w.word LEFT JOIN last ON last.word = w.word
""" % {"lower": _AZ.format("text"), "crc": _CRC32.format("k")}  # fmt: skip


def queries() -> dict:
    return {
        "op1_language_id": op1_language_id,
        "op2_decontaminate": op2_decontaminate,
        "op3_toxicity": op3_toxicity,
        "op4_quality": op4_quality,
        "op5_chat": op5_chat,
        "op6_warc": op6_warc,
        "op7_pieces": op7_pieces,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_near_dedup": op9_near_dedup,
        "op10_secrets": op10_secrets,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_bpe": op12_bpe,
        "op13_spelling": op13_spelling,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": OP2_SQL, "op6_warc": OP6_SQL, "op8_exact_dedup": OP8_SQL, "op9_near_dedup": OP9_SQL, "op11_prefix_trie": OP11_SQL, "op13_spelling": OP13_SQL}
