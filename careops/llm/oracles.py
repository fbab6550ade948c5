"""DuckDB SQL of the queries that SQL can express (same column names and types)."""

from __future__ import annotations

from careops.llm import mixing
from careops.llm.warc import BASE32

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
spot AS (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM d WHERE len(words) >= 8),
win AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 7), ' ') AS w FROM spot),
twice AS (SELECT doc_id, w FROM win GROUP BY doc_id, w HAVING count(*) > 1),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS i FROM win JOIN twice USING (doc_id, w)),
reps AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM line
         WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (
  SELECT d.doc_id, d.text, d.words, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dups.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(reps.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN dups ON d.doc_id = dups.doc_id LEFT JOIN reps ON d.doc_id = reps.doc_id),
judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         10 * n_symbols > n_words
         OR word_chars < 2 * n_words OR word_chars > 15 * n_words
         OR 10 * n_dup_lines > 3 * len(string_split(text, chr(10)))
         OR 2 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > length(regexp_replace(text, '[^A-Za-z]', '', 'g'))
         OR 2 * length(regexp_replace(text, '[A-Za-z\x20\x09-\x0D]|[^\x00-\x7F]', '', 'g')) > word_chars
         OR 20 * list_unique(words) < n_words AS rejected
  FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT rejected AS kept
FROM judged
"""

OP4 = """
WITH c AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
bad AS (SELECT DISTINCT vec_id FROM c WHERE x IS NULL OR NOT isfinite(CAST(x AS DOUBLE))),
v AS (SELECT vec_id, i, CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM c
      WHERE vec_id NOT IN (SELECT vec_id FROM bad)),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(sum(q.x * v.x) AS BIGINT) AS score
      FROM v AS q JOIN v ON q.i = v.i AND q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0 GROUP BY q.vec_id, v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10
"""

OP6 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
spot AS (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM d WHERE len(words) >= 13),
win AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 12), ' ') AS w FROM spot),
least AS (SELECT w, min(doc_id) AS doc_id FROM win GROUP BY w),
gone AS (SELECT DISTINCT win.doc_id, unnest(range(win.i, win.i + 13)) AS i
         FROM win JOIN least ON win.w = least.w AND win.doc_id > least.doc_id),
word AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS line, count(*) AS n
         FROM word WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = word.doc_id AND gone.i = word.i)
         GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(line, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

_DIGIT = " || ".join(
    f"substr('{BASE32}', (((CAST('0x' || substr(h, {5 * i + 1}, 5) AS BIGINT)) >> {15 - 5 * k}) & 31) + 1, 1)"
    for i in range(8) for k in range(4))

OP9 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
o AS (SELECT html, max(page_id) AS original FROM p GROUP BY html)
SELECT page_id, CAST(octet_length(encode(p.html)) AS BIGINT) AS payload_bytes, {_DIGIT} AS payload_digest,
       CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> original THEN original END AS refers_to
FROM p JOIN o ON p.html = o.html
"""

_W = mixing.WEIGHTS
_WEIGHT = "CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {n} {cases} END".format(
    n=len(_W), cases=" ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(_W)))


def _draw(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


OP10 = f"""
WITH d AS (SELECT doc_id, source, coalesce(CAST(doc_id AS VARCHAR), text, '') AS drawn, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
b AS (SELECT *, {_draw(f"'{mixing.SEED}:' || drawn")}
             % greatest(1, (SELECT (count(*) + {mixing.BUCKET_ROWS - 1}) // {mixing.BUCKET_ROWS} FROM d)) AS bucket FROM d),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
w AS (SELECT source, CAST(source_size AS DOUBLE) AS size, CAST({_WEIGHT} AS DOUBLE) AS weight,
             CAST({mixing.MAX_COPIES} * source_size AS DOUBLE) AS most FROM s),
o AS (SELECT *, sum(size) OVER () AS total, sum(weight) OVER () AS all_weight,
             coalesce(sum(most) OVER z, 0) AS most_before, coalesce(sum(weight) OVER z, 0) AS weight_before
      FROM w WINDOW z AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, (total - most_before) / (all_weight - weight_before) AS share FROM o),
t AS (SELECT source, CAST(size AS BIGINT) AS source_size,
             CASE WHEN most <= share * weight THEN most
                  ELSE max(CASE WHEN most > share * weight THEN share END) OVER () * weight END AS target FROM r),
k AS (SELECT b.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
             {_draw(f"'{mixing.SEED}:offset:' || coalesce('=' || b.source, '')")} / 4294967296.0 AS off,
             row_number() OVER (PARTITION BY b.source ORDER BY bucket, size, doc_id NULLS LAST) AS n
      FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(least(floor(off + rate * n) - floor(off + rate * (n - 1)), {mixing.MAX_COPIES}) AS BIGINT) * size AS taken
FROM k
"""

OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
                  string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
p AS (SELECT lang, unnest(pieces) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
total AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY lang),
spot AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w),
gram AS (SELECT lang, list_slice(words, i, i + k - 1) AS g FROM spot, range(1, 6) AS z(k) WHERE i + k - 1 <= len(words)),
f AS (SELECT lang, g, count(*) AS n FROM gram GROUP BY lang, g HAVING count(*) >= 100),
c AS (SELECT lang, g, n AS a FROM f WHERE len(g) > 1),
inside AS (SELECT lang, list_slice(g, i, i + k - 1) AS g, max(a) AS longer
           FROM c, range(2, 5) AS z(k), range(1, 5) AS y(i) WHERE k < len(g) AND i + k - 1 <= len(g) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN inside ON c.lang = inside.lang AND c.g = inside.g
         WHERE longer IS NULL OR 100 * longer < 100 * a),
cut AS (SELECT kept.lang, kept.g, a, x.n AS l, y.n AS r, total.n, z.k,
               (CAST(1000 AS HUGEINT) * a * total.n) // (CAST(x.n AS HUGEINT) * y.n) AS score
        FROM kept JOIN range(1, 5) AS z(k) ON z.k < len(kept.g) JOIN total ON total.lang = kept.lang
        JOIN f AS x ON x.lang = kept.lang AND x.g = list_slice(kept.g, 1, z.k)
        JOIN f AS y ON y.lang = kept.lang AND y.g = list_slice(kept.g, z.k + 1, len(kept.g))),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM low)
SELECT lang, CAST(rank AS BIGINT) AS rank, array_to_string(g, ' ') AS phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
       CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM o WHERE rank <= 2000
"""

ORACLES: dict[str, str] = {
    "op2_quality_cascade": OP2,
    "op4_exact_topk": OP4,
    "op6_substring_dedup": OP6,
    "op9_warc_revisit": OP9,
    "op10_mix_sources": OP10,
    "op11_collocations": OP11,
}
