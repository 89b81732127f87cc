"""One query per operator, over its whole table, with the oracle where SQL can state it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from postlake.llm import (
    bpe, byte_bpe, decontaminate, fim, html, jaccard, lines, neighbours, pii, runs, secrets, suffix, toxicity,
)

TOKENIZER = "word_bpe_49k.json"
RANKS = "byte_bpe_50k.tiktoken"
#: A user brings a key of their own; with this one the registered query is repeatable.
PII_KEY = b"postlake-demonstration-key"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def byte_ranks() -> tuple[str, str]:
    """The rank file and the pattern that cuts texts for it."""
    import public_tokenizers

    return public_tokenizers.path(RANKS), public_tokenizers.PATTERN


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup(_texts(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_texts(spark, sf_dir))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_texts(spark, sf_dir), tokenizer_path())


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_texts(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(_texts(spark, sf_dir), _table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(_texts(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(_texts(spark, sf_dir), _table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(_texts(spark, sf_dir), PII_KEY).select("doc_id", "n_replaced", "pii_spans", "text")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(_texts(spark, sf_dir))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(_texts(spark, sf_dir), *byte_ranks())


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(_texts(spark, sf_dir))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_ngram_join": op2_ngram_join,
    "op3_bpe": op3_bpe,
    "op4_secrets": op4_secrets,
    "op5_neighbours": op5_neighbours,
    "op6_toxicity": op6_toxicity,
    "op7_line_dedup": op7_line_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_main_text": op9_main_text,
    "op10_pseudonyms": op10_pseudonyms,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES = {
    "op7_line_dedup": """
    WITH l AS (
      SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    r AS (
      SELECT doc_id, unnest(ls) AS raw, unnest(range(len(ls))) AS pos FROM l),
    f AS (
      SELECT doc_id, pos, trim(raw, ' ' || chr(9) || chr(13)) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS place
      FROM r WHERE trim(raw, ' ' || chr(9) || chr(13)) <> ''),
    w AS (
      SELECT doc_id, place, line || chr(10) || coalesce(lead(line, 1) OVER d, '') || chr(10) || coalesce(lead(line, 2) OVER d, '') AS win,
        place = 0 OR lead(line, 2) OVER d IS NOT NULL AS ok FROM f WINDOW d AS (PARTITION BY doc_id ORDER BY place)),
    later AS (
      SELECT doc_id, place FROM w WHERE ok QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, place) > 1),
    gone AS (
      SELECT DISTINCT doc_id, place + unnest([0, 1, 2]) AS place FROM later),
    m AS (
      SELECT f.doc_id, f.pos, g.place IS NOT NULL AS removed FROM f LEFT JOIN gone g ON f.doc_id = g.doc_id AND f.place = g.place),
    n AS (
      SELECT doc_id, count(*) AS n_lines, count(*) FILTER (removed) AS n_removed FROM m GROUP BY doc_id),
    k AS (
      SELECT r.doc_id, string_agg(r.raw, chr(10) ORDER BY r.pos) AS kept FROM r LEFT JOIN m ON r.doc_id = m.doc_id AND r.pos = m.pos
      WHERE NOT coalesce(m.removed, false) GROUP BY r.doc_id)
    SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
      sha256(CASE WHEN n_removed > 0 AND n_removed = n_lines THEN '' ELSE coalesce(kept, '') END) AS kept_sha256
    FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN k ON d.doc_id = k.doc_id""",
    "op8_decontamination": r"""
    WITH dw AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    bw AS (
      SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
    b AS (
      SELECT item_id, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i, w FROM bw WHERE len(w) > 0),
    win AS (
      SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s FROM b),
    p AS (
      SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
    hit AS (
      SELECT doc_id, i, p.n AS n, item_id FROM p JOIN win ON win.n = p.n AND win.s = array_to_string(list_slice(p.w, i, i + p.n - 1), ' ')),
    words AS (
      SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id),
    items AS (
      SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY doc_id)
    SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
      sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
    FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op11_fill_in_middle": r"""
    WITH l AS (
      SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS ls,
        sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
    d AS (
      SELECT doc_id, text, ls, len(ls)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(ls) + 1) AS c1, ('0x' || h[9:16])::BIGINT % (len(ls) + 1) AS c2,
        ('0x' || h[17:24])::BIGINT % 100 AS h3, ('0x' || h[25:32])::BIGINT % 100 AS h4 FROM l),
    p AS (
      SELECT doc_id, text, n, array_to_string(ls[1:least(c1, c2)], '') AS a, array_to_string(ls[least(c1, c2) + 1:greatest(c1, c2)], '') AS b,
        array_to_string(ls[greatest(c1, c2) + 1:n], '') AS c,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 100 THEN 'plain'
          WHEN h4 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b
        ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
      sha256(CASE form WHEN 'plain' THEN text ELSE a || b || c END) AS restored_sha256 FROM p""",
}
