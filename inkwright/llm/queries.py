"""The registered queries of this folder, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard_join, lm_scoring, media, mixing, packing, piece_sampling, quality_classifier, quality_rules, substring_dedup, token_counts
from .cluster import fresh_path

WEIGHTS, SHARE, CEILING = (3, 1, 2), 1.5, 2.0
#: Grades: 0 toxic, 1 of poor quality, 2 good.
N_GRADES = 3
LEAST_TAIL = 0.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.copies(table(spark, sf_dir, "documents"), weights=WEIGHTS, share=SHARE, ceiling=CEILING)
    return rows.select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")


OP1_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(md5(text), '')) AS m FROM documents),
binned AS (SELECT *, length(CASE WHEN size = 0 THEN '0' ELSE ltrim(bin(size), '0') END) AS bits,
         substr(CASE WHEN size = 0 THEN '0' ELSE ltrim(bin(size), '0') END, 1, 5) AS lead_bits FROM sized),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w,
         row_number() OVER (ORDER BY source NULLS LAST) AS r, source_size * {CEILING}::DOUBLE AS cap FROM by_source),
levels AS (SELECT *, (sum(source_size) OVER () * {SHARE}::DOUBLE - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
  FROM weighed WINDOW o AS (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, least(cap, max(level) OVER () * w) AS target,
  ('0x' || substr(md5('mix|' || coalesce('s:' || source, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM levels),
laid AS (SELECT b.doc_id, b.size, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY b.source ORDER BY bits, lead_bits, substr(m, 1, 2), m, b.doc_id NULLS FIRST, b.size) AS upto
  FROM binned b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(upto * rate + u) - floor((upto - 1) * rate + u)))::BIGINT AS taken FROM laid
"""


#: Words and their 20-word windows as strings; a window repeats where an equal one starts earlier.
OP4_SQL = f"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i + 1 : i + {substring_dedup.WINDOW}], ' ') AS w
  FROM (SELECT doc_id, ws, unnest(range(len(ws) - {substring_dedup.WINDOW - 1})) AS i FROM split)),
again AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id NULLS FIRST, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM again, range({substring_dedup.WINDOW}) AS r(k)),
each AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM split),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT s.doc_id, len(s.ws)::BIGINT AS n_words, (len(s.ws) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM split s LEFT JOIN kept k USING (doc_id)
"""

#: Pairs by their common 5-grams: Jaccard is at least 0.8 where nine times these are at least four times all; classes by reaching.
OP6_SQL = f"""
WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(ws[i + 1 : i + {jaccard_join.SHINGLE}], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(greatest(len(ws) - {jaccard_join.SHINGLE - 1}, 1))) AS i FROM split WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
near AS (SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 9 * c >= 4 * (x.n + y.n)),
links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a),
classes AS (SELECT doc_id, min(other) AS class_id FROM reach GROUP BY doc_id),
counts AS (SELECT a AS doc_id, count(*) AS n FROM links GROUP BY a)
SELECT c.doc_id, c.class_id, coalesce(n, 0)::BIGINT AS n_links FROM classes c LEFT JOIN counts USING (doc_id)
"""

#: The stored form built byte by byte: a 44-byte header, the samples; CRC-32 of the last 64 by its table.
OP9_SQL = """
WITH bits AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END) AS v FROM range(256) AS r(i))),
raw AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
sized AS (SELECT *, greatest(64, (n + 63) // 64 * 64)::BIGINT AS p FROM raw),
filled AS (SELECT doc_id, n, p, h || repeat('00', (p - n)::BIGINT) AS h FROM sized),
listed AS (SELECT *, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::UBIGINT) AS b FROM filled),
le AS (SELECT *, lambda_le(36 + p) AS a, lambda_le(p) AS z FROM listed),
stored AS (SELECT *, '52494646' || a || '57415645666D742010000000' || '01000100' || '401F0000' || '401F0000' || '01000800' || '64617461' || z || h AS m FROM le)
SELECT doc_id, n AS n_bytes, p AS payload_bytes, sha256(unhex(h)) AS payload_sha256,
  xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, b[p - 63 : p]), lambda c, x: xor(t[((xor(c, x) & 255) + 1)::BIGINT], c >> 8)))::BIGINT AS tail_crc32,
  (p + 44)::BIGINT AS media_bytes, sha256(unhex(m)) AS media_sha256,
  'audio/wav;objects=1;mean=' || (list_sum(b) * 1000 // p)::BIGINT || ';min=' || list_min(b) || ';max=' || list_max(b) AS feature
FROM stored, bits
"""
for _name, _value in (("lambda_le(36 + p)", "(36 + p)"), ("lambda_le(p)", "(p)")):
    # Four bytes, the least first.
    OP9_SQL = OP9_SQL.replace(_name, " || ".join(f"right('0' || hex(({_value} >> {8 * k}) & 255), 2)" for k in range(4)))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A cache of its own for each call: a result never rests on an earlier run.
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer=token_counts.tokenizer_file("word_bpe_49k.json"), cache=fresh_path(spark, "token-cache"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.sample_pieces(table(spark, sf_dir, "documents"), model=token_counts.tokenizer_file("piece_bpe_32k.model"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.filter("quality = 1 and toxic = 0").select("doc_id")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit_log_ratios(docs, trusted_ids(table(spark, sf_dir, "labels"))))


def graded(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled texts with their grade: 0 toxic, 1 of poor quality, 2 good."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    # A bounded sample of labels: its ids are few, so the texts needn't be shuffled to meet them.
    few = labels.select("doc_id", grade.alias("_grade")).filter("_grade is not null").orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "_grade").limit(quality_classifier.MAX_LABELLED)
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")


def fit_classifier(docs: DataFrame, labels: DataFrame) -> quality_classifier.OrdinalModel:
    return quality_classifier.fit(graded(docs, labels), key="doc_id", text="text", grade="_grade", n_grades=N_GRADES)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_classifier(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.grade_texts(docs.select("doc_id", "text"), model).select("doc_id", "expected_grade", "p_tail", (F.col("p_tail") >= LEAST_TAIL).alias("kept"))


def op9_media_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), tokenizer=token_counts.tokenizer_file("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN, id_bytes=2, position_bytes=2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mix, op2_lm_scoring, op3_token_counts, op4_substring_dedup, op5_piece_sampling, op6_jaccard_join, op7_quality_rules, op8_quality_classifier, op9_media_sniffing, op10_packing)
}
ORACLE_SQL = {"op1_mix": OP1_SQL, "op4_substring_dedup": OP4_SQL, "op6_jaccard_join": OP6_SQL, "op9_media_sniffing": OP9_SQL}
