"""SQL that DuckDB can run for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from kinweave.llm.collocations import CONTAINED, SCALE, THRESHOLD, TOP, UNKNOWN
from kinweave.llm.linededup import MIN_WORDS
from kinweave.llm.merkle import FIELDS, TAMPERED
from kinweave.llm.mixing import EXPONENT, SEED

#: Every run of lines as text: a run is removed where an equal run of enough words stands earlier.
LINE_DEDUP = rf"""
WITH docs AS (SELECT *, string_split(text, chr(10)) AS lines FROM documents),
numbered AS (
    SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM docs
), worded AS (
    SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM numbered
), ordered AS (
    SELECT *, row_number() OVER w AS seq, sum(words) OVER w AS upto FROM worded WHERE words > 0
    WINDOW w AS (PARTITION BY doc_id ORDER BY place)
), runs AS (
    SELECT doc_id, seq, (SELECT min(b.seq) FROM ordered b WHERE b.doc_id = a.doc_id AND b.upto >= a.upto - a.words + {MIN_WORDS}) AS last
    FROM ordered a
    UNION
    SELECT doc_id, (SELECT max(b.seq) FROM ordered b WHERE b.doc_id = a.doc_id AND b.upto - b.words <= a.upto - {MIN_WORDS}), seq
    FROM ordered a
), texts AS (
    SELECT r.doc_id, r.seq, r.last, string_agg(o.line, chr(10) ORDER BY o.seq) AS content
    FROM runs r JOIN ordered o ON o.doc_id = r.doc_id AND o.seq BETWEEN r.seq AND r.last
    WHERE r.seq IS NOT NULL AND r.last IS NOT NULL GROUP BY ALL
), later AS (
    SELECT * FROM texts QUALIFY row_number() OVER (PARTITION BY content ORDER BY doc_id, seq) > 1
), gone AS (
    SELECT DISTINCT o.doc_id, o.place FROM later l JOIN ordered o ON o.doc_id = l.doc_id AND o.seq BETWEEN l.seq AND l.last
), counted AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1),
rest AS (
    SELECT n.doc_id, string_agg(n.line, chr(10) ORDER BY n.place) AS text
    FROM numbered n LEFT JOIN gone g ON g.doc_id = n.doc_id AND g.place = n.place WHERE g.place IS NULL GROUP BY 1
)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(r.text, '') END AS text, d.lang, d.source, d.n_chars,
    CAST(coalesce(len(d.lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_removed
FROM docs d LEFT JOIN counted c ON c.doc_id = d.doc_id LEFT JOIN rest r ON r.doc_id = d.doc_id
"""

MIXING = f"""
WITH per_source AS (
    SELECT source, sum(length(coalesce(text, ''))) AS chars FROM documents GROUP BY 1
), weighted AS (
    SELECT *, CASE WHEN chars > 0 THEN pow(chars::DOUBLE, {EXPONENT}) ELSE 0 END AS weight FROM per_source
), rates AS (
    SELECT source, CASE WHEN chars > 0 THEN weight / (SELECT sum(weight) FROM weighted)
        * (SELECT sum(chars)::DOUBLE FROM weighted) / chars ELSE 1.0 END AS rate
    FROM weighted
), terms AS (
    SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS k FROM rates
), factorials AS (
    SELECT *, sum(CASE WHEN k > 0 THEN ln(k) ELSE 0.0 END) OVER w AS log_k FROM terms
    WINDOW w AS (PARTITION BY source ORDER BY k)
), steps AS (
    SELECT source, rate, k, sum(exp(k * ln(rate) - rate - log_k)) OVER (PARTITION BY source ORDER BY k) AS step FROM factorials
), hashed AS (
    SELECT *, ('0x' || substr(md5('{SEED}-copies|' || doc_id), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents
), counted AS (
    SELECT h.doc_id, h.source, count(*) AS n, any_value(s.rate) AS rate
    FROM hashed h JOIN steps s ON s.source = h.source WHERE s.step <= h.u GROUP BY 1, 2
), copies AS (SELECT doc_id, rate, unnest(range(1, n + 1)) AS copy FROM counted)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, round(c.rate, 6) AS mix_rate, CAST(c.copy AS INTEGER) AS mix_copy,
    round(('0x' || substr(md5('{SEED}-order|' || d.doc_id || '|' || c.copy), 1, 13))::BIGINT / 4503599627370496.0, 9) AS mix_key
FROM copies c JOIN documents d ON d.doc_id = c.doc_id
"""



def _leaf(n_chars: str) -> str:
    values = [n_chars if name == "n_chars" else name for name in FIELDS]
    parts = [f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR), '-')" for v in values]
    return f"sha256({' || '.join(parts)})"


#: The checksum takes a byte at a time and eight shifts for each; trees grow a level a round.
MANIFEST = f"""
WITH RECURSIVE summed AS (
    SELECT *, xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
        lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))
    )) AS crc FROM documents
), leaves AS (
    SELECT doc_id, lang, {_leaf("n_chars")} AS leaf,
        CASE WHEN crc % {TAMPERED} = 0 AND n_chars IS NOT NULL THEN {_leaf("(n_chars + 1)")} ELSE {_leaf("n_chars")} END AS held
    FROM summed
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves
), nodes AS (
    SELECT lang, 0 AS level, pos, n, leaf AS h FROM placed
    UNION ALL
    SELECT lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY lang, level, pos // 2, n
), subroots AS (
    SELECT lang, h, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), upper AS (
    SELECT 0 AS level, pos, n, h FROM subroots
    UNION ALL
    SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM upper WHERE n > 1 GROUP BY level, pos // 2, n
), steps AS (
    SELECT p.lang, p.pos, o.level AS step, (p.pos >> o.level) % 2 AS side, s.h
    FROM placed p JOIN (SELECT DISTINCT lang, level, n FROM nodes WHERE n > 1) o ON o.lang IS NOT DISTINCT FROM p.lang
    LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM p.lang AND s.level = o.level AND s.pos = xor(p.pos >> o.level, 1)
    UNION ALL
    SELECT p.lang, p.pos, r.height + o.level, (r.pos >> o.level) % 2, s.h
    FROM placed p JOIN subroots r ON r.lang IS NOT DISTINCT FROM p.lang JOIN (SELECT DISTINCT level FROM upper WHERE n > 1) o ON true
    LEFT JOIN upper s ON s.level = o.level AND s.pos = xor(r.pos >> o.level, 1)
), proofs AS (
    SELECT lang, pos, sha256(coalesce(string_agg(h, '' ORDER BY step), '')) AS proof FROM steps GROUP BY lang, pos
), folded AS (
    SELECT lang, pos, 0 AS step, held AS h FROM placed
    UNION ALL
    SELECT f.lang, f.pos, f.step + 1, sha256(CASE WHEN s.h IS NULL THEN f.h WHEN s.side = 1 THEN s.h || f.h ELSE f.h || s.h END)
    FROM folded f JOIN steps s ON s.lang IS NOT DISTINCT FROM f.lang AND s.pos = f.pos AND s.step = f.step
), ends AS (SELECT lang, pos, max_by(h, step) AS h FROM folded GROUP BY lang, pos)
SELECT p.doc_id, p.leaf, r.h AS subroot, t.h AS root, coalesce(x.proof, sha256('')) AS proof_sha256, e.h AS folded_root, e.h = t.h AS verified
FROM placed p JOIN subroots r ON r.lang IS NOT DISTINCT FROM p.lang JOIN upper t ON t.n = 1
JOIN ends e ON e.lang IS NOT DISTINCT FROM p.lang AND e.pos = p.pos
LEFT JOIN proofs x ON x.lang IS NOT DISTINCT FROM p.lang AND x.pos = p.pos
"""

COLLOCATIONS = rf"""
WITH pieces AS (
    SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece
    FROM documents
), worded AS (
    SELECT lang, list_filter(string_split_regex(piece, '[ 	]+'), lambda w: w <> '') AS w FROM pieces
), totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY 1),
sized AS (SELECT lang, w, unnest(range(1, 5)) AS words FROM worded),
grams AS (SELECT lang, words, w, unnest(range(1, len(w) - words + 2)) AS place FROM sized),
counts AS (
    SELECT lang, array_to_string(w[place:place + words - 1], ' ') AS phrase, words, count(*) AS f
    FROM grams GROUP BY ALL HAVING count(*) >= {THRESHOLD}
), cut AS (
    SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, words)) AS k FROM counts WHERE words > 1
), cuts AS (
    SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, ({SCALE}::HUGEINT * c.a // (x.f + y.f))::BIGINT AS score
    FROM cut c JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[:c.k], ' ')
    JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')
), scored AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
    SELECT lang, string_split(phrase, ' ') AS w, words, f, unnest(range(2, words)) AS size FROM counts WHERE words > 2
), within AS (SELECT lang, w, f, size, unnest(range(1, words - size + 2)) AS place FROM longer),
most AS (SELECT lang, array_to_string(w[place:place + size - 1], ' ') AS phrase, max(f) AS most FROM within GROUP BY 1, 2),
ranked AS (
    SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank
    FROM scored s LEFT JOIN most m ON m.lang = s.lang AND m.phrase = s.phrase
    WHERE m.most IS NULL OR 100 * m.most < {CONTAINED} * s.a
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= {TOP}
"""

ORACLE = {
    "op4_line_dedup": LINE_DEDUP,
    "op7_mixing": MIXING,
    "op11_manifest": MANIFEST,
    "op12_collocations": COLLOCATIONS,
}
