"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, chroma, codes, langid, maxscore, mixing, pii, quality, repeats, simhash, token_counts, toxicity, tries
from quire.llm.common import in_training_fold, table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without bytes that repeat anywhere in strings of 400."""
    return repeats.removals(table(spark, sf_dir, "documents")).drop("spans")


def _with_fold(scored: DataFrame, mod: int, held: int, threshold: float | None = None) -> DataFrame:
    out = scored.withColumn("held_out", ~in_training_fold(mod, held))
    if threshold is None:
        return out.select("doc_id", "held_out", "lang_pred", "score")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicts every document's language."""
    docs = table(spark, sf_dir, "documents")
    return _with_fold(langid.identify(docs, langid.learn(docs)), 5, 0)


def op4_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes taken as 8-bit sound: fingerprints of all, each twentieth aligned with all."""
    media = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("audio"))
    return chroma.search(chroma.fingerprints(media)).withColumnRenamed("rec_id", "doc_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document's toxicity."""
    docs = table(spark, sf_dir, "documents")
    return _with_fold(toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels"))), 5, 0, toxicity.THRESHOLD)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document's quality."""
    docs = table(spark, sf_dir, "documents")
    return _with_fold(quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels"))), 4, 2, quality.THRESHOLD)


def op9_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Every document's tokens, counted in flat token shards by a separator scan."""
    path = path or tokenizer_path()
    return token_counts.count_documents(table(spark, sf_dir, "documents"), path, token_counts.special_id(path))


def op10_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best matches of every twentieth vector among all."""
    return maxscore.top_k(table(spark, sf_dir, "embeddings"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the components of near-duplicates."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("row_key")


def op6_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Encodes every whole text and decodes the ids: digests of both."""
    return bpe.digests(table(spark, sf_dir, "documents"), path or tokenizer_path())


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes all documents to target weights."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations, with totals of every subtree."""
    return tries.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors over codebooks that two rounds fit."""
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text: counts, a digest of the base spans, and all spans."""
    return pii.digests(pii.find(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_repeats, op2_langid, op3_simhash, op4_chroma, op5_toxicity, op6_bpe, op7_mixing, op8_quality, op9_token_counts, op10_maxscore, op11_trie, op12_codes, op13_pii)}

#: For op13: proposing expressions, and which proposals stay. Lists of parts and matches give the places of matches.
_LUHN = "list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN d[length(d) - i + 1]::INT ELSE 2 * d[length(d) - i + 1]::INT - 9 * (d[length(d) - i + 1] > '4')::INT END)) % 10 = 0"
_NEAR = f"regexp_matches(lower(substr(text, greatest(0, s - {pii.BEFORE}) + 1, s - greatest(0, s - {pii.BEFORE}))), '\\b(%s)\\b') OR regexp_matches(lower(substr(text, e + 1, {pii.AFTER})), '\\b(%s)\\b')"
_MOD_97 = "list_reduce(list_transform(string_split(substr(w, 5) || left(w, 4), ''), lambda c: (CASE WHEN c BETWEEN '0' AND '9' THEN unicode(c) - 48 ELSE unicode(c) - 55 END)::BIGINT), lambda a, c: (a * (CASE WHEN c > 9 THEN 100 ELSE 10 END) + c) % 97) = 1"
_PII = {
    "email": ("[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+", "true"),
    "ip": ("[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)", "len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR lpad(right(p, 3), 3, '0') > '255')) = 0"),
    "card": ("[0-9]([\\x20-]?[0-9])+", f"length(d) BETWEEN 16 AND 19 AND {_LUHN}"),
    "phone": ("\\+[0-9][\\x20().0-9-]+[0-9]", "length(d) BETWEEN 8 AND 15"),
    "iban": ("\\b[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})\\b", f"length(w) BETWEEN 15 AND 34 AND {_MOD_97}"),
    "national_id": ("\\b[0-9]{3}-[0-9]{2}-[0-9]{4}\\b", f"(s = 0 OR substr(text, s, 1) <> '-') AND substr(text, e + 1, 1) <> '-' AND left(x, 3) NOT IN ('000', '666') AND left(x, 3) < '900' AND substr(x, 5, 2) <> '00' AND right(x, 4) <> '0000' AND ({_NEAR.replace('%s', pii.CONTEXT['national_id'])})"),
    "local_phone": ("\\b[0-9]{3,4}[ .-][0-9]{3,4}(?:[ .-][0-9]{2,4}){0,2}\\b", f"length(d) BETWEEN 7 AND 12 AND ({_NEAR.replace('%s', pii.CONTEXT['local_phone'])})"),
}


def _pii_sql() -> str:
    parts = ["WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents)"]
    for n, (kind, (pattern, stays)) in enumerate(_PII.items()):
        short = "UNION ALL SELECT * REPLACE (regexp_replace(x, ' [A-Z0-9]+$', '') AS x, e - length(regexp_extract(x, ' [A-Z0-9]+$')) AS e, 1 AS short) FROM p{n} WHERE regexp_matches(x, ' [A-Z0-9]+$')".format(n=n) if kind == "iban" else ""
        earlier = " UNION ALL ".join(f"SELECT r, s, e FROM k{i}" for i in range(n))
        free = f"WHERE NOT EXISTS (SELECT 1 FROM ({earlier}) o WHERE o.r = q{n}.r AND o.s < q{n}.e AND q{n}.s < o.e)" if kind in pii.ADDED else ""
        parts.append(f"""
        m{n} AS (SELECT *, regexp_extract_all(text, '{pattern}') AS xs, string_split_regex(text, '{pattern}') AS gaps FROM t),
        u{n} AS (SELECT r, doc_id, text, unnest(xs) AS x, unnest(gaps[1:len(xs)]) AS gap, generate_subscripts(xs, 1) AS i FROM m{n}),
        p{n} AS (SELECT r, doc_id, text, x, (sum(length(gap) + length(x)) OVER (PARTITION BY r ORDER BY i))::BIGINT AS e, 0 AS short FROM u{n}),
        f{n} AS (SELECT *, e - length(x) AS s, regexp_replace(x, '[^0-9]', '', 'g') AS d, replace(x, ' ', '') AS w FROM (SELECT * FROM p{n} {short})),
        q{n} AS (SELECT r, {n} AS k, '{kind}' AS kind, s, min_by(e, short) AS e FROM f{n} WHERE {stays} GROUP BY r, s),
        k{n} AS (SELECT * FROM q{n} {free})""")
    every = " UNION ALL ".join(f"SELECT * FROM k{n}" for n in range(len(_PII)))
    listed = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s){}, '')"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.BASE)
    base = f" FILTER (k < {len(pii.BASE)})"
    parts.append(f"a AS ({every}) SELECT any_value(doc_id) AS doc_id, {counts}, sha256({listed.format(base)}) AS base_sha256, {listed.format('')} AS spans FROM t LEFT JOIN a USING (r) GROUP BY r")
    return ",\n".join(parts)


_CRC = "xor(4294967295, list_reduce(flatten(list_transform(string_split(c::VARCHAR, ''), lambda b: [unicode(b)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda a, i: CASE WHEN i >= 0 THEN xor(a, i) ELSE xor(a >> 1, 3988292384 * (a & 1)) END, 4294967295::BIGINT))"
_TRIE = f"""
        WITH t AS (SELECT conv_id AS c, {{'r': coalesce(role, ''), 'x': coalesce(text, '')}} AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM conversations WHERE conv_id IS NOT NULL),
        o AS (SELECT c, list(t ORDER BY n) AS own, {_CRC} % 6 AS h FROM t GROUP BY c),
        b AS (SELECT o.c, list_concat(coalesce(p.own, [])[1:o.h], o.own[o.h + 1:]) AS path FROM o LEFT JOIN o p ON p.c = o.c - o.c % 100),
        m AS (SELECT c, d AS depth, path[1:d] AS node, path[1:d - 1] AS up, len(path) = d AS ends FROM b, unnest(range(0, len(path) + 1)) u(d)),
        g AS (SELECT node, any_value(up) AS up, depth, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY node, depth),
        k AS (SELECT up, depth - 1 AS depth, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY ALL),
        v AS (SELECT g.*, coalesce(n_children, 0) AS n_children, CASE WHEN g.depth = 0 THEN 0 ELSE (n_convs - 1) * length(g.node[g.depth].x) END AS own FROM g LEFT JOIN k ON k.up = g.node AND k.depth = g.depth),
        s AS (SELECT w.node[1:d] AS node, d AS depth, sum(own)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM v w, unnest(range(0, w.depth + 1)) u(d) GROUP BY ALL)
        SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves, s.saved_tokens, v.ends_sha256
        FROM v JOIN s ON s.node = v.node AND s.depth = v.depth LEFT JOIN v p ON p.node = v.up AND p.depth = v.depth - 1
    """


def _codes_sql(wide: int = 4) -> str:
    """For vectors of 64 components."""
    dims = range(1, wide + 1)
    far = " + ".join(f"(p.x[{i}] - b.x[{i}]) * (p.x[{i}] - b.x[{i}])" for i in dims)
    near = f"SELECT p.r, p.part, min(({far}) * 64 + b.entry) AS best FROM p JOIN %s b USING (part) GROUP BY p.r, p.part"
    fitted = "SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM %s b LEFT JOIN (SELECT p.part, (a.best & 63) AS entry, [" + ", ".join(f"floor(sum(p.x[{i}]) / count(*))::BIGINT" for i in dims) + "] AS x FROM p JOIN %s a USING (r, part) GROUP BY ALL) m USING (part, entry)"
    return f"""
        WITH v AS (
            SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), p AS MATERIALIZED (SELECT r, vec_id, label, j AS part, e[j * {wide} + 1 : j * {wide} + {wide}] AS x FROM v, range(16) t(j)),
        b0 AS (SELECT part, r - 1 AS entry, x FROM p WHERE r <= 64),
        a0 AS MATERIALIZED ({near % "b0"}), b1 AS MATERIALIZED ({fitted % ("b0", "a0")}),
        a1 AS MATERIALIZED ({near % "b1"}), b2 AS MATERIALIZED ({fitted % ("b1", "a1")}),
        a2 AS ({near % "b2"}),
        h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2),
        c AS (SELECT r, string_agg(printf('%02x', best & 63), '' ORDER BY part) AS code, sum(best // 64)::BIGINT AS error FROM a2 GROUP BY r)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c JOIN v USING (r), h
    """


#: For DuckDB; an operator without an entry is tested against a brute-force version.
ORACLES: dict[str, str] = {
    "op10_maxscore": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
    "op11_trie": _TRIE,
    "op12_codes": _codes_sql(),
    "op13_pii": _pii_sql(),
}
