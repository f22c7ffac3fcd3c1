"""One named query per text operator, over its whole table with production parameters, and its SQL twin if it has one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochwise.llm import alignment, decontaminate, dialogues, lines, packing, quality, rules, simhash, substrings, suffixes, tokenfiles, toxicity, warc
from epochwise.session import load, materialize, new_path

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def trusted(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "labels").filter("quality = 1").select("doc_id")


def op1_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judge(load(spark, sf, "documents"), trusted(spark, sf))


def op3_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = lines.drop_repeated_line_windows(load(spark, sf, "documents"))
    return out.select("doc_id", "n_lines", "n_removed_lines", F.md5("kept_text").alias("kept_md5"))


OP3_SQL = """WITH d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS l FROM documents),
  x AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS p FROM d),
  w AS (SELECT doc_id, p, line AS a, lead(line) OVER o AS b, lead(line, 2) OVER o AS c FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
  hit AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, p) AS r FROM w WHERE c IS NOT NULL) WHERE r > 1),
  cov AS (SELECT DISTINCT doc_id, p + k AS p FROM hit, range(3) AS t(k)),
  kept AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY p) AS s FROM x ANTI JOIN cov USING (doc_id, p) GROUP BY doc_id)
  SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - coalesce(n, 0) AS BIGINT) AS n_removed_lines, md5(coalesce(s, '')) AS kept_md5
  FROM d LEFT JOIN kept USING (doc_id)"""


def op4_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = substrings.drop_repeated_windows(load(spark, sf, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP4_SQL = f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
  win AS (SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
  hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS n FROM win) WHERE n > 1),
  cov AS (SELECT DISTINCT doc_id, i + k AS p FROM hit, range(35) AS t(k)),
  kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS s, count(*) AS n
    FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN cov USING (doc_id, p) GROUP BY doc_id)
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
  FROM d LEFT JOIN kept USING (doc_id)"""


def op8_suffix_array_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = suffixes.drop_earlier_strings(load(spark, sf, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


# Bytes as pairs of hexadecimal digits, so that a 50-byte string is a substring of 100 digits.
OP8_SQL = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
  win AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d)),
  hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM win) WHERE first < doc_id),
  runs AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (
    SELECT doc_id, i, sum(CASE WHEN i - p <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g
    FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM hit)) GROUP BY doc_id, g),
  gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS e FROM runs),
  kept AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last,
    string_agg(substr(h, CAST(2 * e + 1 AS BIGINT), CAST(2 * (a - e) AS BIGINT)), '' ORDER BY a) AS s FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
  SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
    sha256(unhex(coalesce(s || substr(h, CAST(2 * last + 1 AS BIGINT)), h))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""


def op2_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(load(spark, sf, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.find_leaks(load(spark, sf, "documents"), load(spark, sf, "benchmark"))


def _seed_sql(words: str, keys: str) -> str:
    rows = (f"SELECT {keys}, i, {n} AS k, [{', '.join(f'w[i + {p + 1}]' for p in m)}] AS s FROM (SELECT {keys}, w, unnest(range(0, len(w) - {m[-1]})) AS i FROM {words})" for n, m in enumerate(decontaminate.MASKS))
    return " UNION ALL ".join(rows)


# Words in lower case without marks at their ends; a word of marks alone stays.
_MARKS = decontaminate.MARKS.replace("'", "''")
FOLDED = f"list_transform(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''), lambda w: CASE WHEN trim(w, '{_MARKS}') = '' THEN w ELSE trim(w, '{_MARKS}') END)"
# Blocks of short items: one more than there may be substitutions.
_PARTS = "(n - CAST(ceil(n * 0.8 - 1e-9) AS BIGINT) + 1)"

OP5_SQL = f"""WITH d AS MATERIALIZED (SELECT doc_id, {FOLDED} AS w FROM documents), b AS MATERIALIZED (SELECT item_id, {FOLDED} AS w FROM benchmark),
  bl AS (SELECT item_id, w, n * q // {_PARTS} AS i, n * (q + 1) // {_PARTS} AS e FROM (SELECT item_id, w, len(w) AS n FROM b), range(0, 4) AS t(q) WHERE n BETWEEN 1 AND {decontaminate.SHORT} AND q < {_PARTS}),
  sb AS ({_seed_sql("b", "item_id")} UNION ALL SELECT item_id, i, 100 + e - i, w[i + 1 : e] FROM bl),
  sd AS ({_seed_sql("d", "doc_id")} UNION ALL SELECT doc_id, i, 100 + k, w[i + 1 : i + k] FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT e - i AS k FROM bl))),
  o AS (SELECT DISTINCT doc_id, item_id, sd.i - sb.i AS o FROM sd JOIN sb USING (k, s)),
  e AS (SELECT doc_id, item_id, o, least(16, len(b.w)) AS n, q, len(d.w) AS nd, len(b.w) AS nb, CASE WHEN o + q >= 0 AND d.w[o + q + 1] = b.w[q + 1] THEN 1 ELSE 0 END AS e
    FROM o JOIN d USING (doc_id) JOIN b USING (item_id), range(0, 100000) AS t(q) WHERE q < len(b.w)),
  v AS (SELECT doc_id, item_id, o, n, CASE WHEN n = 16 THEN sum(e) OVER r16 ELSE sum(e) OVER rall END AS m,
      q + n <= nb AND o + q >= 0 AND o + q + n <= nd AS inside FROM e
    WINDOW r16 AS (PARTITION BY doc_id, item_id, o ORDER BY q ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING),
      rall AS (PARTITION BY doc_id, item_id, o ORDER BY q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  g AS (SELECT doc_id, item_id, max((m, n, -o)) AS x FROM v WHERE inside AND m >= ceil(n * 0.8) GROUP BY doc_id, item_id)
  SELECT doc_id, item_id, CAST(x[1] AS BIGINT) AS n_matched, CAST(x[2] AS BIGINT) AS n_compared, CAST(-x[3] AS BIGINT) AS start FROM g"""


def op6_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf, "documents")).select("doc_id", "fingerprint", "component_id")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_token_files(spark: SparkSession, sf: str) -> DataFrame:
    files = tokenfiles.write_tokens(load(spark, sf, "documents"), new_path(spark, "tokens"), tokenizer_path())
    return tokenfiles.read_documents(spark, files)


def op7_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.classify(load(spark, sf, "documents"), load(spark, sf, "labels")).select("doc_id", "held_out", "score", "predicted")


def op10_warc_fixity_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Audit of a replica whose records are damaged by rules on the page id: bytes changed, cut off, lost, or moved."""
    pages = load(spark, sf, "pages")
    layout = materialize(warc.lay_out(pages), "layout")
    left = layout.select("archive", "offset", (F.col("length") * F.col("copies")).alias("length"), F.col("digest").alias("content_hash"))
    hit = lambda by, rest: F.pmod(F.coalesce("id", F.lit(0)), F.lit(by)) == rest
    bytes_now = F.when(hit(97, 5), F.concat(F.expr("left(content, length(content) - 1)"), F.lit("#"))).when(hit(83, 7), F.expr("left(content, length(content) - 10)")).otherwise(F.col("content"))
    stored = warc.contents(pages).select("id", "digest", bytes_now.alias("now")).select("id", "digest", F.sha2("now", 256).alias("content_hash"), F.octet_length("now").alias("size")).distinct()
    at = layout.select(F.col("id").alias("at_id"), F.col("digest").alias("at_digest"), "archive", "offset", "copies")
    placed = stored.join(at, F.col("id").eqNullSafe(F.col("at_id")) & (F.col("digest") == F.col("at_digest"))).filter(~hit(89, 3))
    right = placed.select(
        "archive", (F.col("offset") + F.when(hit(79, 11), 1).otherwise(0)).alias("offset"), ((F.col("size") + len(warc.END)) * F.col("copies")).alias("length"), "content_hash"
    )
    return warc.audit(left, right).fillna(0, ["left_length", "right_length"])


OP10_SQL = """WITH c AS (SELECT page_id AS id, 'WARC/1.0' || E'\r\n' || 'WARC-Type: resource' || E'\r\n' || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), 'none') || '>'
      || E'\r\n' || 'WARC-Target-URI: ' || coalesce(url, '') || E'\r\n' || 'WARC-Block-Digest: sha1:' || sha1(coalesce(html, '')) || E'\r\n' || 'Content-Type: text/html'
      || E'\r\n' || 'Content-Length: ' || octet_length(encode(coalesce(html, ''))) || E'\r\n\r\n' || coalesce(html, '') AS t FROM pages),
  u AS (SELECT id, t, sha256(t) AS h, octet_length(encode(t)) + 4 AS n, count(*) AS copies FROM c GROUP BY ALL),
  p AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) % CAST(ceil((SELECT count(*) FROM u) / 512) AS BIGINT) AS archive FROM u),
  l AS (SELECT *, coalesce(sum(n * copies) OVER (PARTITION BY archive ORDER BY id NULLS FIRST, h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM p),
  r AS (SELECT archive, o + CASE WHEN coalesce(id, 0) % 79 = 11 THEN 1 ELSE 0 END AS o, copies,
      CASE WHEN coalesce(id, 0) % 97 = 5 THEN t[1:length(t) - 1] || '#' WHEN coalesce(id, 0) % 83 = 7 THEN t[1:length(t) - 10] ELSE t END AS t FROM l WHERE coalesce(id, 0) % 89 <> 3),
  a AS (SELECT archive, o, n * copies AS n, h FROM l), b AS (SELECT archive, o, (octet_length(encode(t)) + 4) * copies AS n, sha256(t) AS h FROM r)
  SELECT archive, CAST(o AS BIGINT) AS "offset", CASE WHEN b.h IS NULL THEN 'missing' WHEN a.h IS NULL THEN 'extra' ELSE 'changed' END AS status,
    CAST(coalesce(a.n, 0) AS BIGINT) AS left_length, CAST(coalesce(b.n, 0) AS BIGINT) AS right_length
  FROM a FULL JOIN b USING (archive, o) WHERE a.h IS DISTINCT FROM b.h OR a.n IS DISTINCT FROM b.n"""


def op11_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return rules.rate(load(spark, sf, "documents"), load(spark, sf, "labels")).drop("statistics")


def op12_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Repair of conversations that are damaged by a rule on conversation and turn: rows lost, emptied, unfinished, doubled, or the user's."""
    turns = load(spark, sf, "conversations")
    name = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", None, "turn")])
    rule = F.crc32(name) % 20
    text = F.coalesce("text", F.lit(" "))
    hurt = turns.select(
        "conv_id", "turn", F.when(rule == 4, "user").otherwise(F.col("role")).alias("role"), F.when(rule == 1, "").when(rule == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(rule == 0, 0).when(rule == 3, 2).otherwise(1).alias("copies"))
    return dialogues.repair(hurt, copies=F.col("copies"))


def op13_tokenizer_alignment(spark: SparkSession, sf: str) -> DataFrame:
    out = alignment.align(load(spark, sf, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    return out.drop("groups")


QUERIES = {
    "op1_quality_rules": (op1_quality_rules, None),
    "op2_best_fit_packing": (op2_best_fit_packing, None),
    "op3_line_dedup": (op3_line_dedup, OP3_SQL),
    "op4_substring_dedup": (op4_substring_dedup, OP4_SQL),
    "op5_benchmark_decontamination": (op5_benchmark_decontamination, OP5_SQL),
    "op6_simhash_near_dedup": (op6_simhash_near_dedup, None),
    "op7_toxicity": (op7_toxicity, None),
    "op8_suffix_array_dedup": (op8_suffix_array_dedup, OP8_SQL),
    "op9_token_files": (op9_token_files, None),
    "op10_warc_fixity_audit": (op10_warc_fixity_audit, OP10_SQL),
    "op11_quality_classifier": (op11_quality_classifier, None),
    "op12_conversation_repair": (op12_conversation_repair, None),
    "op13_tokenizer_alignment": (op13_tokenizer_alignment, None),
}
