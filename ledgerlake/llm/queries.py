"""The registered queries of this folder, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import (
    decontamination,
    filter_audit,
    language,
    merkle_manifest,
    ngram_join,
    pages,
    pieces,
    quality,
    secrets,
    sharding,
    topk,
    toxicity,
    url_filter,
)
from ledgerlake.llm.tables import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents."""
    return decontamination.passages(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 85 % of their shingles of four words."""
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finds of every document."""
    return secrets.scan(table(spark, sf_dir, "documents")).drop("found")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return language.identify(table(spark, sf_dir, "documents"))


def op6_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return pages.extract(table(spark, sf_dir, "pages"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best other vectors of every twentieth vector."""
    return topk.exact_topk(table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, with its significant passages."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, decoded again for comparison."""
    return pieces.encode_ids(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of equal row counts, each with the mixture of sources."""
    return sharding.interleave(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all 120 orders, per source."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and root of every document, and the root that its tampered version has."""
    return merkle_manifest.manifest(table(spark, sf_dir, "documents")).drop("tree", "at")


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL, by rules, then by the list of unwanted pages."""
    pages_ = table(spark, sf_dir, "pages")
    judged = url_filter.judge(pages_, url_filter.unwanted_pages(pages_))
    return judged.select("page_id", "host", "path", "rule", "verdict")


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_quality": op3_quality,
    "op4_secrets": op4_secrets,
    "op5_language": op5_language,
    "op6_pages": op6_pages,
    "op7_topk": op7_topk,
    "op8_toxicity": op8_toxicity,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_sharding": op10_sharding,
    "op11_filter_audit": op11_filter_audit,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_url_filter": op13_url_filter,
}

_STEPS = """
    WITH words AS (
        SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body,
               regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
        FROM documents
    ),
    facts AS (
        SELECT doc_id, part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
               100 * (length(body) - length(regexp_replace(body, '[A-Z]', '', 'g'))) > 5 * length(body) AS c,
               regexp_matches(body, '[#$%&*|]') AS d,
               coalesce(doc_id > min(doc_id) OVER (PARTITION BY body), false) AS e
        FROM words
    ),
    labelled AS (
        SELECT f.*, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic
        FROM facts f LEFT JOIN (
            SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
        ) l USING (doc_id)
    ),
    masks AS (
        SELECT part, {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS fails, count(*) AS n,
               count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
        FROM labelled GROUP BY ALL
    ),
    letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    orders AS (
        SELECT p.x || q.x || r.x || s.x || t.x AS filter_order
        FROM letters p, letters q, letters r, letters s, letters t
        WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
    ),
    steps AS (
        SELECT filter_order, step::INTEGER AS step, filter_order[step] AS letter,
               string_split(filter_order[:step - 1], '') AS earlier
        FROM orders, range(1, 6) r(step)
    ),
    outcomes AS (
        SELECT part, filter_order, step, letter, n, good, toxic,
               map_extract_value(own, letter) AS fails,
               len(list_filter(earlier, lambda l: map_extract_value(own, l))) > 0 AS gone,
               len(list_filter(map_values(own), lambda v: v)) = 1 AS alone
        FROM (SELECT *, MAP {'A': fails.A, 'B': fails.B, 'C': fails.C, 'D': fails.D, 'E': fails.E} AS own
              FROM masks), steps
    ),
    counted AS (
        SELECT part, filter_order, step, letter,
               coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0)::BIGINT AS kept,
               coalesce(sum(n) FILTER (NOT gone AND fails), 0)::BIGINT AS removed,
               coalesce(sum(n) FILTER (gone AND fails), 0)::BIGINT AS redundant,
               coalesce(sum(n) FILTER (fails AND alone), 0)::BIGINT AS unique_fails,
               coalesce(sum(good) FILTER (NOT gone AND fails), 0)::BIGINT AS good_lost,
               coalesce(sum(toxic) FILTER (NOT gone AND fails), 0)::BIGINT AS toxic_lost
        FROM outcomes GROUP BY ALL
    )
    SELECT * EXCLUDE (letter), (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
    FROM counted
"""


def _told(field: str) -> str:
    return f"coalesce(strlen({field}::VARCHAR)::VARCHAR || ':' || {field}::VARCHAR, '-')"


def _merkle_sql(levels: int = 7) -> str:
    """The manifest level by level; `levels` of eights are enough for two million rows of a language."""
    told = {f: _told(f) for f in ("doc_id", "source", "lang", "n_chars", "text")}
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    changed = told | {"text": _told(lower)}
    # DuckDB has no crc32: bit by bit over the decimals of the id
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    crc = (
        "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), "
        "lambda ch: [unicode(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), "
        f"lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE {step} END), 4294967295)"
    )
    ctes = [
        f"""t AS (SELECT doc_id, lang, sha256({' || '.join(told.values())}) AS leaf,
            CASE WHEN {crc} % 3 = 0 THEN sha256({' || '.join(changed.values())}) END AS other
        FROM documents)""",
        """p0 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
            coalesce(other, leaf) AS folded, '' AS proof FROM t)""",
        "n0 AS (SELECT lang, pos, leaf AS h, count(*) OVER (PARTITION BY lang) AS total FROM p0)",
    ]

    def up(k: int, tree: str) -> None:
        """From level k to the next one: runs of eight, then every document's own way."""
        ctes.append(f"""r{k} AS (SELECT {tree}, pos // 8 AS run, total, list(h ORDER BY pos) AS hs
            FROM n{k} GROUP BY ALL)""")
        ctes.append(f"""n{k + 1} AS (SELECT {tree}, run AS pos,
            CASE WHEN total > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h,
            (total + 7) // 8 AS total FROM r{k})""")
        ctes.append(f"""p{k + 1} AS (SELECT p.* REPLACE (p.pos // 8 AS pos,
            CASE WHEN total > 1 THEN proof || array_to_string(hs[:p.pos % 8], '')
              || array_to_string(hs[p.pos % 8 + 2:], '') ELSE proof END AS proof,
            CASE WHEN total > 1 THEN sha256(array_to_string(hs[:p.pos % 8], '') || folded
              || array_to_string(hs[p.pos % 8 + 2:], '')) ELSE folded END AS folded)
            FROM p{k} p JOIN r{k} r ON r.run = p.pos // 8 AND r.{tree} IS NOT DISTINCT FROM p.{tree})""")

    for k in range(levels):
        up(k, "lang")
    ctes.append(f"""langs AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos,
        count(*) OVER () AS total FROM n{levels})""")
    k = levels + 1
    ctes.append(f"n{k} AS (SELECT 0 AS tree, pos, subroot AS h, total FROM langs)")
    ctes.append(f"""p{k} AS (SELECT p.* EXCLUDE (pos), langs.pos, subroot, 0 AS tree
        FROM p{levels} p JOIN langs ON p.lang IS NOT DISTINCT FROM langs.lang)""")
    for k in range(levels + 1, levels + 4):
        up(k, "tree")
    return f"""WITH {', '.join(ctes)}
        SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
            folded = h AS verified
        FROM p{levels + 4}, n{levels + 4}"""


_HOST = "translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SITE = r"regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^www\.', '')"
_URLS = f"""
    WITH after AS (
        SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
        FROM pages
    ),
    parts AS (
        SELECT page_id, coalesce({_HOST}, '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
            list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1), '&'),
                lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref)(=|$)'))) AS asked
        FROM after
    ),
    addresses AS (
        SELECT *, CASE WHEN host <> '' THEN {_SITE}
            || regexp_replace(path, '(/index)?\\.html?$|/+$', '')
            || CASE WHEN len(asked) > 0 THEN '?' || array_to_string(asked, '&') ELSE '' END END AS address
        FROM parts
    ),
    listed AS (
        SELECT DISTINCT address FROM addresses
        WHERE list_has_any(regexp_split_to_array(host, '[.-]'),
            [{', '.join(f"'{t}'" for t in url_filter.TELLING)}])
    ),
    rules(verdict, h, p) AS (VALUES {', '.join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in url_filter.RULES)}),
    fitting AS (
        SELECT page_id, host, path, address, arg_max(h || p, length(h || p)) AS rule,
            arg_max(verdict, length(h || p)) AS verdict
        FROM addresses LEFT JOIN rules
            ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
        GROUP BY ALL
    )
    SELECT page_id, host, path, rule,
        coalesce(verdict, CASE WHEN address IN (FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
    FROM fitting
"""

#: Every two documents with a common shingle are compared, and components follow links to their end: for
#: tables of some thousand documents.
_LINKED = """
    WITH RECURSIVE worded AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
        FROM documents
    ),
    sets AS (
        SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
            ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s
        FROM worded
    ),
    shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
    links AS (
        SELECT a.doc_id AS x, b.doc_id AS y
        FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
        GROUP BY a.doc_id, b.doc_id, a.n, b.n
        HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
    ),
    reached AS (
        SELECT doc_id, doc_id AS other FROM sets
        UNION
        SELECT reached.doc_id, y FROM reached JOIN links ON other = x
    )
    SELECT doc_id, len(s) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links
    FROM sets
    JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) USING (doc_id)
    LEFT JOIN (SELECT x AS doc_id, count(*) AS n_links FROM links GROUP BY x) USING (doc_id)
"""

ORACLES = {
    "op2_ngram_jaccard": _LINKED,
    "op11_filter_audit": _STEPS,
    "op12_merkle_manifest": _merkle_sql(),
    "op13_url_filter": _URLS,
    "op7_topk": """
        WITH taking AS (
            SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS vec
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   list_inner_product(q.vec, c.vec)::BIGINT AS score
            FROM taking q JOIN taking c ON q.vec_id <> c.vec_id AND len(q.vec) = len(c.vec)
            WHERE q.vec_id % 20 = 0
        )
        SELECT query_id,
               row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
               vec_id, score
        FROM scored
        QUALIFY rank <= 20
    """,
}
