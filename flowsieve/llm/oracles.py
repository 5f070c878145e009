"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from flowsieve.llm.hamming import BITS
from flowsieve.llm.phrases import BEST, LEAST_COUNT, LONGEST
from flowsieve.llm.warc import LEAST_REVISIT_BYTES

PREFERENCES = """
WITH turns AS (
    SELECT conv_id AS pair_id, turn, role, text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST) - 1 AS place
    FROM conversations WHERE conv_id IS NOT NULL
),
last AS (SELECT pair_id, max(place) AS place FROM turns WHERE role = 'assistant' GROUP BY pair_id),
answers AS (SELECT pair_id, turn, text, row_number() OVER (ORDER BY pair_id) - 1 AS nth, count(*) OVER () AS total
    FROM turns JOIN last USING (pair_id, place)),
rejected AS (
    SELECT t.pair_id, turn, role, text FROM turns t LEFT JOIN last l USING (pair_id) WHERE l.place IS NULL OR t.place < l.place
    UNION ALL
    SELECT a.pair_id, a.turn, 'assistant', b.text FROM answers a JOIN answers b ON b.nth = (a.nth + 1) % a.total WHERE a.total > 1
),
a AS (SELECT * FROM turns),
b AS (SELECT *, row_number() OVER (
    PARTITION BY pair_id ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST) - 1 AS place FROM rejected),
differs AS (
    SELECT pair_id, min(place) FILTER (
        a.pair_id IS NULL OR b.pair_id IS NULL OR a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text) AS first
    FROM a FULL JOIN b USING (pair_id, place) GROUP BY pair_id
),
parts AS (
    SELECT pair_id, CASE WHEN first IS NULL OR place < first THEN 'prompt' ELSE 'chosen' END AS part, place, role, text, first
    FROM a JOIN differs USING (pair_id)
    UNION ALL
    SELECT pair_id, 'rejected', place, role, text, first FROM b JOIN differs USING (pair_id) WHERE place >= first
),
rendered AS (
    SELECT pair_id, part, place - CASE WHEN part = 'prompt' THEN 0 ELSE first END AS place, role,
        '<|start|>' || coalesce(role, '') || chr(10) AS header, coalesce(text, '') || '<|end|>' || chr(10) AS body
    FROM parts
),
placed AS (
    SELECT *, coalesce(sum(length(header) + length(body)) OVER (
        PARTITION BY pair_id, part ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
    FROM rendered
)
SELECT pair_id, part, place, role, header || body AS rendered, start, start + length(header) AS loss_start,
    CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(body) ELSE 0 END::BIGINT AS loss_length
FROM placed
"""

TOP_K = f"""
WITH v AS (SELECT vec_id, embedding AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
d AS (
    SELECT q.vec_id AS query_id, v.vec_id,
        list_sum(list_transform(range(1, {BITS + 1}), lambda i: ((coalesce(q.e[i], 0) > 0) <> (coalesce(v.e[i], 0) > 0))::INT))::BIGINT AS distance
    FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""

CAPTURES = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
l AS (SELECT payload_digest, max(page_id) AS last FROM d WHERE payload_bytes >= {LEAST_REVISIT_BYTES} GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id < last THEN last END AS refers_to
FROM d LEFT JOIN l USING (payload_digest)
"""

# lower-cased A-Z only, as the operator does
_TERMS = r"""regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

RANKED = f"""
WITH occurring AS (SELECT doc_id, unnest({_TERMS.format('text')}) AS term FROM documents),
lengths AS (SELECT doc_id, count(*) AS n FROM occurring GROUP BY doc_id),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS occurrences FROM lengths),
postings AS (SELECT doc_id, term, count(*) AS tf FROM occurring GROUP BY doc_id, term),
weights AS (
    SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, total GROUP BY term
),
asked AS (SELECT item_id, unnest({_TERMS.format('text')}) AS term FROM benchmark),
scored AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // occurrences))))::BIGINT AS score
    FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN lengths USING (doc_id), total GROUP BY item_id, doc_id
),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 20
"""

COLLOCATIONS = f"""
WITH texts AS (SELECT row_number() OVER () AS row_no, coalesce(lang, 'und') AS lang,
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT row_number() OVER () AS piece, lang, part
    FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS part FROM texts)),
listed AS (SELECT lang, piece, regexp_extract_all(part, '[^\\x20\\x09]+') AS ws FROM pieces),
total AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM listed GROUP BY lang),
grams AS (SELECT lang, ws[i:i + k - 1] AS g FROM (
    SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM (SELECT lang, ws, unnest(range(1, {LONGEST + 1})) AS k FROM listed))),
f AS (SELECT lang, g, count(*) AS a FROM grams GROUP BY lang, g HAVING count(*) >= {LEAST_COUNT}),
c AS (SELECT * FROM f WHERE len(g) > 1),
inside AS (SELECT DISTINCT lang, g[i:i + w - 1] AS g, a FROM (
    SELECT lang, g, a, w, unnest(range(1, len(g) - w + 2)) AS i FROM (SELECT lang, g, a, unnest(range(2, len(g))) AS w FROM c))),
kept AS (SELECT * FROM c ANTI JOIN inside USING (lang, g, a)),
cuts AS (SELECT lang, g, a, k, g[1:k] AS lg, g[k + 1:] AS rg FROM (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM kept)),
scored AS (
    SELECT cuts.lang, cuts.g, cuts.a, k, x.a AS l, y.a AS r, n, ((1000::HUGEINT * cuts.a * n) // (x.a::HUGEINT * y.a))::BIGINT AS score
    FROM cuts JOIN f x ON x.lang = cuts.lang AND x.g = lg JOIN f y ON y.lang = cuts.lang AND y.g = rg JOIN total ON total.lang = cuts.lang
),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
r AS (SELECT *, array_to_string(g, ' ') AS phrase,
    row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM weakest)
SELECT lang, rank, phrase, a, l, r.r, n, score FROM r WHERE rank <= {BEST}
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op5_preference_formatting": PREFERENCES, "op6_hamming_top_k": TOP_K,
        "op10_warc_captures": CAPTURES, "op12_ranked_lexical_search": RANKED, "op13_phrase_collocations": COLLOCATIONS,
    }
