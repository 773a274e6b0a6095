"""The registered queries of this package, one for each operator, and their SQL."""

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from codelode.llm import branch_bound, config_packing, cube_mix, exact_dedup, merkle, prefix_counts, rtree, secret_ledger, set_skipping, sharding, toxicity, url_rules, wavelet
from codelode.sources.shared import shared_folder

# Rules of the URL query.
URL_RULES = [
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"),
]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_branch_bound(spark: SparkSession, folder: str) -> DataFrame:
    return branch_bound.top_inner_products(_table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_cube_mix(spark: SparkSession, folder: str) -> DataFrame:
    return cube_mix.mix_sources(_table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_set_skipping(spark: SparkSession, folder: str) -> DataFrame:
    return set_skipping.near_duplicates(_table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_config_packing(spark: SparkSession, folder: str) -> DataFrame:
    return config_packing.pack_documents(_table(spark, folder, "documents"))


def op5_wavelet(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    wavelet.write_token_files(_table(spark, folder, "documents"), path)
    return wavelet.read_token_files(spark, path, with_ids=False)


def op6_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.judge_urls(_table(spark, folder, "pages"), url_rules.rules_table(spark, URL_RULES))


def op7_secret_ledger(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_ledger.scan_with_ledger(_table(spark, folder, "documents"), secret_ledger.new_ledger(spark))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    return toxicity.score_documents(documents, toxicity.fit_toxicity(documents, _table(spark, folder, "labels")))


def op9_prefix_counts(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_counts.token_counts(_table(spark, folder, "documents"))


def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(_table(spark, folder, "documents"), keep="largest")
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_merkle(spark: SparkSession, folder: str) -> DataFrame:
    def without_line_feeds(documents: DataFrame) -> dict:
        chosen = F.crc32(documents["doc_id"].cast("string").cast("binary")) % 2 == 0
        return {"text": F.when(chosen, F.translate(documents["text"], "\n", "")).otherwise(documents["text"])}

    return merkle.verified_documents(_table(spark, folder, "documents"), without_line_feeds)


def op12_rtree(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rtree.hard_negatives(_table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, label)


def op13_virtual_slots(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.place(_table(spark, folder, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


QUERIES = {f.__name__: f for f in (
    op1_branch_bound, op2_cube_mix, op3_set_skipping, op4_config_packing, op5_wavelet, op6_url_rules, op7_secret_ledger, op8_toxicity, op9_prefix_counts,
    op10_exact_dedup, op11_merkle, op12_rtree, op13_virtual_slots,
)}

_LEAF = "sha256(" + " || ".join(
    f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}")
) + ")"
_PRODUCTS = """
        whole AS (SELECT vec_id, {label} AS label, [floor({scale} * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
                  WHERE embedding IS NOT NULL AND {label} IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        scores AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, list_inner_product(a.v, b.v)::BIGINT AS score
                   FROM whole a JOIN whole b ON a.vec_id % {every} = 0 AND a.vec_id <> b.vec_id)"""

ORACLES = {
    "op1_branch_bound": f"""
        WITH {_PRODUCTS.format(label='0', scale=64, every=20)},
        ranked AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS rank FROM scores)
        SELECT anchor_id AS query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
    "op3_set_skipping": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x20\x09-\x0D]+') AS w FROM documents),
        placed AS (SELECT doc_id, len(w) AS size, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM words),
        runs AS (SELECT doc_id, size, i, concat_ws(' ', w, lead(w, 1) OVER p, lead(w, 2) OVER p, lead(w, 3) OVER p, lead(w, 4) OVER p) AS g
                 FROM placed WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
        rows AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM (SELECT DISTINCT doc_id, g FROM runs WHERE i = 1 OR i <= size - 4)),
        shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c, any_value(a.n) AS n, any_value(b.n) AS m
                   FROM rows a JOIN rows b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
        links AS (SELECT x, y FROM shared WHERE 100 * c >= 80 * (n + m - c)),
        reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
        least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
        SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM words w JOIN least ON x = doc_id
        LEFT JOIN (SELECT DISTINCT doc_id, n FROM rows) r ON r.doc_id = w.doc_id
    """,
    "op11_merkle": f"""
        WITH RECURSIVE
        bytes AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, e: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)
                              ORDER BY i) AS crc FROM range(256) t(i)),
        marked AS (SELECT *, list_reduce(list_prepend(4294967295, [ascii(d)::BIGINT FOR d IN string_split(doc_id::VARCHAR, '')]),
                                         lambda c, b: xor(crc[xor(c % 256, b) + 1], c // 256)) % 2 AS odd FROM documents, bytes),
        leaves AS (SELECT doc_id, coalesce('s' || source, '') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos,
                          count(*) OVER (PARTITION BY source) AS n, {_LEAF.format(text='text')} AS leaf,
                          CASE WHEN odd = 1 THEN {_LEAF.format(text="replace(text, chr(10), '')")} ELSE {_LEAF.format(text='text')} END AS seen FROM marked),
        nodes AS (SELECT 0 AS level, tree, pos, n, leaf AS digest FROM leaves UNION ALL
                  SELECT level + 1, tree, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY level, tree, pos // 3, n),
        tops AS (SELECT tree, level AS height, digest, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
        above AS (SELECT 0 AS level, place AS pos, n, digest FROM tops UNION ALL
                  SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM above WHERE n > 1 GROUP BY level, pos // 3, n),
        runs AS (SELECT l.tree, l.pos, x.level, x.digest, x.pos - l.pos // (3 ** x.level)::BIGINT AS side FROM leaves l
                 JOIN nodes x ON x.tree = l.tree AND x.n > 1 AND x.pos // 3 = l.pos // (3 ** (x.level + 1))::BIGINT
                 UNION ALL SELECT l.tree, l.pos, 1000 + x.level, x.digest, x.pos - t.place // (3 ** x.level)::BIGINT FROM leaves l
                 JOIN tops t ON t.tree = l.tree JOIN above x ON x.n > 1 AND x.pos // 3 = t.place // (3 ** (x.level + 1))::BIGINT),
        steps AS (SELECT tree, pos, row_number() OVER (PARTITION BY tree, pos ORDER BY level) AS k,
                         coalesce(string_agg(digest, '' ORDER BY side) FILTER (side < 0), '') AS before,
                         coalesce(string_agg(digest, '' ORDER BY side) FILTER (side > 0), '') AS after FROM runs GROUP BY tree, pos, level),
        proofs AS (SELECT tree, pos, string_agg(before || after, '' ORDER BY k) AS proof FROM steps GROUP BY tree, pos),
        folds AS (SELECT tree, pos, 0 AS k, seen AS node FROM leaves UNION ALL
                  SELECT f.tree, f.pos, s.k, sha256(s.before || f.node || s.after) FROM folds f JOIN steps s ON s.tree = f.tree AND s.pos = f.pos AND s.k = f.k + 1),
        folded AS (SELECT tree, pos, max_by(node, k) AS folded_root FROM folds GROUP BY tree, pos)
        SELECT doc_id, leaf, t.digest AS subroot, a.digest AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root,
               folded_root = a.digest AS verified
        FROM leaves JOIN folded USING (tree, pos) JOIN tops t USING (tree) JOIN above a ON a.n = 1 LEFT JOIN proofs USING (tree, pos)
    """,
    "op12_rtree": f"""
        WITH {_PRODUCTS.format(label='(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)', scale=256, every=50)},
        friends AS (SELECT * FROM scores WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        hard AS (SELECT f.anchor_id, f.vec_id AS positive_id, s.vec_id AS negative_id, f.score AS positive_score, s.score AS negative_score,
                        row_number() OVER (PARTITION BY f.anchor_id, f.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
                 FROM friends f JOIN scores s ON s.anchor_id = f.anchor_id AND s.label <> s.own
                   AND 50 * f.score <= 100 * s.score AND 100 * s.score <= 95 * f.score)
        SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM hard WHERE rank <= 3
    """,
    "op6_url_rules": """
        WITH rules(host, path, verdict) AS (VALUES
            ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
            ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
                FROM pages),
        parts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut),
        split AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM parts),
        best AS (SELECT s.page_id, s.host, s.path, max({'size': length(r.host || r.path), 'rule': r.host || r.path, 'verdict': r.verdict}) AS r
                 FROM split s LEFT JOIN rules r
                   ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path)
                 GROUP BY s.page_id, s.host, s.path)
        SELECT page_id, host, path, r.rule AS rule, coalesce(r.verdict, 'allow') AS verdict FROM best
    """,
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
}
