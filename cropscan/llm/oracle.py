"""DuckDB SQL for the text queries that SQL can express."""

_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\pL\pN]+'), lambda x: x <> '')"


def _lloyd(step: int) -> str:
    """Assignment to centroids ``c{step}`` and the centroids after it."""
    return f"""
        a{step} AS MATERIALIZED (
            SELECT vec_id, cluster, distance FROM (
                SELECT v.vec_id, c.cluster, sum((v.x - c.x) * (v.x - c.x)) AS distance,
                       row_number() OVER (PARTITION BY v.vec_id ORDER BY sum((v.x - c.x) * (v.x - c.x)), c.cluster) AS place
                FROM kept v JOIN c{step} c USING (dim) GROUP BY v.vec_id, c.cluster)
            WHERE place = 1),
        c{step + 1} AS MATERIALIZED (
            SELECT c.cluster, c.dim, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, c.x) AS x
            FROM c{step} c LEFT JOIN (
                SELECT a.cluster, v.dim, sum(v.x) AS s, count(*) AS n
                FROM a{step} a JOIN kept v USING (vec_id) GROUP BY a.cluster, v.dim) m USING (cluster, dim)),"""


ORACLE = {
    "op11_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents),
        ws AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
        grams AS (
            SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
            FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i
                  FROM ws, (SELECT unnest([1, 2, 3, 4]) AS m))),
        f AS (SELECT lang, m, phrase, count(*) AS n FROM grams GROUP BY ALL),
        words AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
        candidates AS (SELECT lang, m, phrase, n, string_split(phrase, ' ') AS w FROM f WHERE m >= 2 AND n >= 30),
        covered AS (
            SELECT DISTINCT s.lang, s.phrase
            FROM candidates s JOIN candidates t ON s.lang = t.lang AND s.m < t.m
                AND contains(' ' || t.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * t.n >= 80 * s.n),
        cuts AS (
            SELECT c.lang, c.phrase, c.n AS a, k, x.n AS l, y.n AS r, (2000000 * c.n::HUGEINT // (x.n + y.n))::BIGINT AS score
            FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates ANTI JOIN covered USING (lang, phrase)) c
            JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ')
            JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:c.m], ' ')),
        best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM cuts),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank
            FROM best WHERE place = 1)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN words USING (lang) WHERE rank <= 2000""",
    "op12_centroids": f"""
        WITH good AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        kept AS MATERIALIZED (SELECT vec_id, unnest(v) AS x, unnest(range(1, 65)) AS dim FROM good),
        chosen AS (
            SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster
            FROM good ORDER BY cluster LIMIT 16),
        c0 AS (SELECT cluster, dim, x FROM chosen JOIN kept USING (vec_id)),
        {_lloyd(0)}{_lloyd(1)}{_lloyd(2)}{_lloyd(3)}
        hashes AS (SELECT cluster, sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY dim)) AS centroid_sha256 FROM c3 GROUP BY cluster)
        SELECT vec_id, cluster::INTEGER AS cluster, distance::BIGINT AS distance,
               sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
               sum(distance) OVER ()::BIGINT AS inertia, centroid_sha256
        FROM a3 JOIN hashes USING (cluster)""",
    "op4_decontamination": f"""
        WITH items AS (
            SELECT item_id, w, len(w) AS n, least(len(w), 5) AS k
            FROM (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
        ish AS (
            SELECT item_id, n, k, pos, array_to_string(w[pos + 1:pos + k], ' ') AS s
            FROM (SELECT *, unnest(range(n - k + 1)) AS pos FROM items)),
        total AS (SELECT count(*)::DOUBLE AS n_items FROM items),
        weights AS (
            SELECT k, s, ln(1 + n_items / count(DISTINCT item_id)) AS weight FROM ish, total GROUP BY k, s, n_items),
        dsh AS (
            SELECT doc_id, k, doc_pos, array_to_string(w[doc_pos + 1:doc_pos + k], ' ') AS s
            FROM (SELECT doc_id, w, k, unnest(range(greatest(len(w) - k + 1, 0))) AS doc_pos
                  FROM (SELECT doc_id, {_WORDS} AS w FROM documents), (SELECT DISTINCT k FROM items))),
        windows AS (
            SELECT DISTINCT doc_id, k, n, doc_pos - pos AS start FROM dsh JOIN (SELECT DISTINCT k, s, n, pos FROM ish) USING (k, s)),
        inside AS (
            SELECT DISTINCT v.doc_id, v.k, v.n, v.start, d.s
            FROM windows v JOIN dsh d ON d.doc_id = v.doc_id AND d.k = v.k AND d.doc_pos BETWEEN v.start AND v.start + v.n - v.k),
        weighed AS (
            SELECT i.*, coalesce(weight, ln(1 + n_items)) AS weight FROM total, inside i LEFT JOIN weights USING (k, s)),
        whole AS (SELECT doc_id, k, n, start, sum(weight) AS window_weight FROM weighed GROUP BY ALL),
        item_sets AS (SELECT DISTINCT item_id, n, k, s FROM ish),
        item_whole AS (SELECT item_id, sum(weight) AS item_weight FROM item_sets JOIN weights USING (k, s) GROUP BY item_id),
        shared AS (
            SELECT doc_id, k, n, start, item_id, sum(weight) AS both_weight
            FROM weighed JOIN item_sets USING (n, k, s) GROUP BY ALL),
        scored AS (
            SELECT doc_id, item_id, n, start,
                   round(both_weight / (item_weight + window_weight - both_weight), 6) AS similarity
            FROM shared JOIN whole USING (doc_id, k, n, start) JOIN item_whole USING (item_id)),
        best AS (
            SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS place
            FROM scored WHERE similarity >= 0.8)
        SELECT doc_id, item_id, n AS n_words, greatest(start, 0) AS start_word, similarity FROM best WHERE place = 1""",
    "op5_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept,
               sha256(d.text) AS text_sha256
        FROM d JOIN g USING (text)""",
    "op9_ngram_jaccard": r"""
        WITH RECURSIVE d AS (
            SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
            UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 2),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        common AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
            FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (
            SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
            WHERE 100 * c >= 90 * (p.n + q.n - c)),
        both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reached AS (
            SELECT doc_id AS x, doc_id AS y FROM d
            UNION SELECT r.x, l.y FROM reached r JOIN both_ways l ON l.x = r.y)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
        FROM (SELECT x AS doc_id, min(y) AS component_id FROM reached GROUP BY x) LEFT JOIN sizes USING (doc_id)""",
}
