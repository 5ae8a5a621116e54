"""The queries opN_<name> of the training-data operators, each over its whole table, and SQL for those that SQL can say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import exact_dedup
from .html_text import html_text
from .language_id import fit, identify
from .license_scan import license_scan
from .line_dedup import MIN_EQUAL, line_decisions
from .media import media_digests, store_texts
from .merkle import proof_digest, verify_tampered
from .mixing import curriculum_mix, in_training_order
from .ngram_join import ngram_jaccard_join
from .packing import pack_documents
from .quality import importance_sample
from .target_sample import target_sample
from .toxicity import fit as fit_toxicity
from .toxicity import labelled, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the rows whose crc32(doc_id as text) mod 5 isn't 0; those with remainder 1 also weigh the classifiers."""
    docs = table(spark, sf_dir, "documents")
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5, F.lit(1))
    found = identify(docs, fit(docs, fold != 0, fold == 1))
    return found.select("doc_id", (fold == 0).alias("held_out"), "lang_pred", "score", "ambiguous")


def op3_importance_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op7_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = in_training_order(curriculum_mix(table(spark, sf_dir, "documents")))
    again = [F.get("turns", F.lit(i))["position"].alias(x) for i, x in enumerate(("position", "position_again"))]
    return mix.select("doc_id", "size", "source_size", "target", "taken", *again)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_decisions(table(spark, sf_dir, "documents"), min_equal=MIN_EQUAL)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(store_texts(table(spark, sf_dir, "documents")))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op11_target_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = target_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows whose crc32(doc_id as text) mod 4 isn't 2."""
    docs = table(spark, sf_dir, "documents")
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4, F.lit(0))
    found = toxicity(docs, fit_toxicity(labelled(docs, table(spark, sf_dir, "labels"), fold != 2)))
    return found.select("doc_id", (fold == 2).alias("held_out"), "score", "predicted")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = verify_tampered(docs, tampered, {"text": lower})
    return rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_language_id, op3_importance_sample, op4_exact_dedup, op5_bin_completion,
        op6_ngram_jaccard, op7_curriculum_mix, op8_line_dedup, op9_media_columns, op10_html_text,
        op11_target_sample, op12_toxicity, op13_merkle_manifest,
    )
}

#: SQL for crc32, byte by byte from its table of 256 values, t: of ASCII texts by their letters, of others by their bytes.
_CRC_TABLE = "crc AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i))"
_CRC_OF = "xor(4294967295, list_reduce({bytes}, lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8), 4294967295))"

ORACLE_SQL = {
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op6_ngram_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
            FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle
            FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(1, len(words) - 4))) AS i FROM w WHERE len(words) > 0)
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        both_ AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
        ), link AS (
            SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)
        ), reach AS (
            SELECT doc_id, doc_id AS r FROM documents
            UNION
            SELECT reach.doc_id, link.b FROM reach JOIN link ON reach.r = link.a
        )
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
        FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
    """,
    "op7_curriculum_mix": r"""
        WITH d AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                   md5(coalesce(doc_id::VARCHAR, '')) AS hash FROM documents
        ), s AS (
            SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source
        ), w AS (
            SELECT *, ([5.0, 2.0, 1.0])[rank % 3 + 1]::DOUBLE AS weight, ([0.5, 0.0, -0.5])[rank % 3 + 1]::DOUBLE AS tilt, source_size * 2.0::DOUBLE AS cap FROM s
        ), p AS (
            SELECT *, cap / weight AS reach,
                   ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE - coalesce(sum(cap) OVER before, 0))
                   / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER before, 0)) AS level
            FROM w WINDOW before AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), l AS (SELECT arg_min(level, (reach, rank)) AS level FROM p WHERE reach > level),
        t AS (
            SELECT source, source_size, tilt, round(CASE WHEN p.reach > p.level THEN weight * l.level ELSE cap END, 6) AS target FROM p LEFT JOIN l ON true
        ), r AS (
            SELECT d.doc_id, size, source_size, target, tilt,
                   coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY hash, d.doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin_
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        ), turn AS (
            SELECT *, greatest(0, least(size, floor(target)::BIGINT - begin_ - source_size * round_)) AS words, begin_ + source_size * round_ AS since
            FROM r, (VALUES (0), (1)) AS v(round_)
        ), x AS (
            -- the t in [0, 1] at which the integral of target * (1 + tilt * (2 u - 1)) from 0 to t is what was asked for by then
            SELECT *, CASE WHEN words > 0 THEN round(CASE WHEN tilt = 0 THEN (since + words / 2.0::DOUBLE) / target
                ELSE (tilt - 1 + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * ((since + words / 2.0::DOUBLE) / target))) / (2 * tilt) END, 9) END AS t
            FROM turn
        )
        SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target, sum(words)::BIGINT AS taken,
               max(t) FILTER (round_ = 0) AS position, max(t) FILTER (round_ = 1) AS position_again
        FROM x GROUP BY doc_id
    """,
    "op11_target_sample": rf"""
        WITH {_CRC_TABLE}, d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), b AS (
            SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), fd AS (
            SELECT doc_id, array_to_string(w[i:i + k], ' ') AS f, count(*) AS n FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 1)) AS i FROM d, range(3) r(k)) GROUP BY ALL
        ), fb AS (
            SELECT array_to_string(w[i:i + k], ' ') AS f, count(*) AS n FROM (SELECT w, k, unnest(range(1, len(w) - k + 1)) AS i FROM b, range(3) r(k)) GROUP BY ALL
        ), h AS (
            SELECT f, {_CRC_OF.format(bytes="list_transform(range(0, strlen(f)), lambda i: ('0x' || hex(encode(f))[2 * i + 1:2 * i + 2])::BIGINT)")} % 10000 AS bucket
            FROM (SELECT f FROM fd UNION SELECT f FROM fb), crc
        ), s AS (SELECT bucket, sum(n)::BIGINT AS s FROM fd JOIN h USING (f) GROUP BY 1), t AS (SELECT bucket, sum(n)::BIGINT AS t FROM fb JOIN h USING (f) GROUP BY 1),
        g AS (
            SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE / ((s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain
            FROM s LEFT JOIN t USING (bucket)
        ), w AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM fd JOIN h USING (f) JOIN g USING (bucket) GROUP BY 1),
        x AS (
            SELECT d.doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                   ('0x' || sha256('42:' || coalesce(d.doc_id::VARCHAR, ''))[1:8])::BIGINT AS h
            FROM d LEFT JOIN w USING (doc_id)
        ), y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM x),
        z AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS r, count_if(words >= 20) OVER () AS n FROM y)
        SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND r <= 5 * n // 100 THEN r END AS rank FROM z
    """,
    "op13_merkle_manifest": rf"""
        WITH RECURSIVE {_CRC_TABLE}, d AS (
            SELECT doc_id, source, coalesce(':' || source, '-') AS tree, {_CRC_OF.format(bytes="list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x))")} % 5 = 0 AS tampered,
                   concat_ws('', coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
                       coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
                   coalesce(strlen(text) || ':' || text, '-') AS tail,
                   coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS changed
            FROM documents, crc
        ), leaf AS (
            SELECT doc_id, tree, sha256(head || tail) AS leaf, CASE WHEN tampered THEN sha256(head || changed) ELSE sha256(head || tail) END AS shown,
                   row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d
        ), up AS (
            SELECT tree, 0 AS level, pos AS i, n, leaf AS digest FROM leaf
            UNION ALL
            SELECT tree, level + 1, i // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY tree, level, i // 16, n
        ), sub AS (SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
        top AS (
            SELECT 0 AS level, pos AS i, n, digest FROM sub
            UNION ALL
            SELECT level + 1, i // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, i // 16, n
        ), node AS (
            SELECT tree, level, i, digest FROM up WHERE n > 1
            UNION ALL
            -- of the upper tree, as levels above those of each lower one
            SELECT s.tree, h.h + t.level, t.i, t.digest FROM top t, sub s JOIN (SELECT tree, max(level) AS h FROM up GROUP BY tree) h USING (tree) WHERE t.n > 1 AND t.i // 16 = (s.pos // (16::BIGINT ** t.level)::BIGINT) // 16
        ), path AS (
            SELECT doc_id, l.tree, h.level, CASE WHEN h.level < h.h THEN l.pos // (16::BIGINT ** h.level)::BIGINT ELSE s.pos // (16::BIGINT ** (h.level - h.h))::BIGINT END AS i
            FROM leaf l JOIN sub s USING (tree) JOIN (SELECT tree, h, unnest(range(0, h + (SELECT max(level) FROM top))) AS level FROM (SELECT tree, max(level) AS h FROM up GROUP BY tree)) h ON h.tree = l.tree
        ), step AS (
            SELECT p.doc_id, p.level, coalesce(string_agg(n.digest, '' ORDER BY n.i) FILTER (n.i < p.i), '') AS l, coalesce(string_agg(n.digest, '' ORDER BY n.i) FILTER (n.i > p.i), '') AS r
            FROM path p JOIN node n ON n.tree = p.tree AND n.level = p.level AND n.i // 16 = p.i // 16 GROUP BY p.doc_id, p.level
        ), proof AS (SELECT doc_id, sha256(string_agg(l || r, '' ORDER BY level)) AS proof_sha256, max(level) + 1 AS levels FROM step GROUP BY doc_id),
        folded AS (
            SELECT doc_id, 0 AS level, shown AS digest FROM leaf
            UNION ALL
            SELECT f.doc_id, f.level + 1, sha256(s.l || f.digest || s.r) FROM folded f JOIN step s ON s.doc_id = f.doc_id AND s.level = f.level
        )
        SELECT l.doc_id, leaf, sub.digest AS subroot, (SELECT digest FROM top WHERE n = 1) AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, f.digest AS folded_root,
               f.digest = (SELECT digest FROM top WHERE n = 1) AS verified
        FROM leaf l JOIN sub USING (tree) LEFT JOIN proof USING (doc_id) JOIN folded f ON f.doc_id = l.doc_id AND f.level = coalesce(levels, 0)
    """,
}
