"""DuckDB SQL for the operators that SQL can express, over whole tables."""

from __future__ import annotations

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Votes in the order of the default rules, and the rounds of EM.
_ENOUGH = "n_words < 20 THEN 0 WHEN "
_VOTES = {
    "v0": "CASE WHEN n_words < 10 THEN -1 WHEN n_words >= 30 THEN 1 ELSE 0 END",
    "v1": f"CASE WHEN {_ENOUGH} n_symbols / n_words >= 0.1 THEN -1 WHEN n_symbols / n_words < 0.02 THEN 1 ELSE 0 END",
    "v2": f"CASE WHEN {_ENOUGH} n_letters = 0 THEN 0 WHEN n_upper / n_letters >= 0.45 THEN -1 WHEN n_upper / n_letters <= 0.2 THEN 1 ELSE 0 END",
    "v3": f"CASE WHEN {_ENOUGH} n_repeat_words / n_words >= 0.45 THEN -1 WHEN n_repeat_words / n_words <= 0.1 THEN 1 ELSE 0 END",
    "v4": f"CASE WHEN {_ENOUGH} (word_chars / n_words < 2 OR word_chars / n_words > 15) THEN -1 WHEN word_chars / n_words BETWEEN 3 AND 10 THEN 1 ELSE 0 END",
    "v5": f"CASE WHEN {_ENOUGH} ln(n_distinct) / ln(n_words) < 0.6 THEN -1 WHEN ln(n_distinct) / ln(n_words) >= 0.75 THEN 1 ELSE 0 END",
    "v6": "CASE WHEN n_lines < 4 THEN 0 WHEN n_dup_lines / n_lines >= 0.5 THEN -1 WHEN n_dup_lines / n_lines <= 0.2 THEN 1 ELSE 0 END",
    "v7": f"CASE WHEN {_ENOUGH} n_letters / word_chars <= 0.75 THEN -1 WHEN n_letters / word_chars >= 0.85 THEN 1 ELSE 0 END",
    "v8": f"CASE WHEN {_ENOUGH} n_marks / n_words >= 0.1 THEN -1 WHEN n_marks / n_words < 0.03 THEN 1 ELSE 0 END",
}
_ROUNDS = 15


def quality_rules() -> str:
    odds = lambda m: f"ln({m}.prior / (1 - {m}.prior)) + " + " + ".join(f"CASE {v} WHEN 1 THEN ln({m}.g{i} / (1 - {m}.b{i})) WHEN -1 THEN ln((1 - {m}.g{i}) / {m}.b{i}) ELSE 0 END" for i, v in enumerate(_VOTES))
    rounds = ["m0 AS (SELECT 0.8::DOUBLE AS prior, " + ", ".join(f"0.97::DOUBLE AS g{i}, 0.4::DOUBLE AS b{i}" for i in range(len(_VOTES))) + ")"]
    share = lambda right, votes, mean, every: f"CASE WHEN {every} > 0 THEN (coalesce({right}, 0) + 0.02 * {every} * {mean}) / ({votes} + 0.02 * {every}) ELSE {mean} END"
    for k in range(_ROUNDS):
        rounds.append(f"e{k} AS (SELECT votes.*, 1 / (1 + exp(-({odds(f'm{k}')}))) AS p FROM votes, m{k})")
        said = lambda v: f"sum(CASE WHEN {v} <> 0 THEN n ELSE 0 END)"
        rates = ", ".join(
            share(f"sum(CASE {v} WHEN 1 THEN n * p END)", f"sum(CASE WHEN {v} <> 0 THEN n * p ELSE 0 END)", 0.97, said(v)) + f" AS g{i}, "
            + share(f"sum(CASE {v} WHEN -1 THEN n - n * p END)", f"sum(CASE WHEN {v} <> 0 THEN n - n * p ELSE 0 END)", 0.4, said(v)) + f" AS b{i}"
            for i, v in enumerate(_VOTES)
        )
        rounds.append(f"m{k + 1} AS (SELECT (sum(n * p) + 0.02 * sum(n) * 0.8) / (1.02 * sum(n)) AS prior, {rates} FROM e{k})")
    return rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS words FROM documents),
l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: trim(x, {BLANKS}) <> '') AS lines FROM w),
pos AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS p FROM w WHERE len(words) >= 3),
tri AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, words[p], words[p + 1], words[p + 2]) AS c FROM pos),
rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM tri WHERE c > 1) GROUP BY 1),
c AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines, length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS n_upper,
  length(regexp_replace(text, '[^\p{{L}}\p{{M}}]+', '', 'g')) AS n_letters, len(list_distinct(words)) AS n_distinct,
  len(regexp_extract_all(text, '[^\p{{L}}\p{{M}}\p{{N}}\x20\x09-\x0D]{{2,}}|(?:^|[\x20\x09-\x0D])[^\p{{L}}\p{{M}}\p{{N}}\x20\x09-\x0D](?:[\x20\x09-\x0D]|\z)')) AS n_marks FROM l LEFT JOIN rep USING (doc_id)),
v AS (SELECT *, {", ".join(f"{sql} AS {name}" for name, sql in _VOTES.items())} FROM c),
votes AS (SELECT {", ".join(_VOTES)}, count(*) AS n FROM v GROUP BY ALL),
{", ".join(rounds)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 1 / (1 + exp(-({odds(f"m{_ROUNDS}")}))) >= 0.5 AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM v), m{_ROUNDS}"""


def ngram_join(n: int = 4, percent: int = 85) -> str:
    shingle = " || ' ' || ".join(f"words[p + {i}]" for i in range(n))
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({LOWER.format(x="coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, {shingle} AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - {n} + 2)) AS p FROM w WHERE len(words) >= {n})
  UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM w WHERE len(words) BETWEEN 1 AND {n} - 1),
k AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
both_in AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_in JOIN k x ON x.doc_id = a JOIN k y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a AS id, b AS other FROM edge UNION SELECT r.id, e.b FROM reach r JOIN edge e ON e.a = r.other)
SELECT d.doc_id, coalesce(k.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.least, d.doc_id)) AS component_id
FROM documents d LEFT JOIN k USING (doc_id) LEFT JOIN (SELECT id, min(other) AS least FROM reach GROUP BY 1) m ON m.id = d.doc_id"""


def substring_dedup(window: int = 50) -> str:
    return f"""
WITH w AS (SELECT doc_id, {WORDS} AS words FROM documents),
win AS (SELECT doc_id, p, md5(array_to_string(words[p:p + {window - 1}], ' ')) AS h FROM (SELECT doc_id, words, unnest(range(1, len(words) - {window} + 2)) AS p FROM w WHERE len(words) >= {window})),
cut AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY h) AS first FROM win) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, q FROM (SELECT doc_id, unnest(range(p, p + {window})) AS q FROM cut)),
word AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS q FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY q) AS text FROM word ANTI JOIN gone USING (doc_id, q) GROUP BY 1)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1) g USING (doc_id)"""


#: Every vector thrice: itself, turned a little towards the next and made longer, and the same again; a chain of two links.
COPIES = "SELECT e.vec_id * 3 + k AS vec_id, e.label, list_transform(list_zip(e.embedding, w.embedding), lambda z: (z[1]::DOUBLE + k * 0.15 * z[2]::DOUBLE) * (k + 1)) AS embedding FROM embeddings e JOIN embeddings w ON w.vec_id = (e.vec_id + 1) % (SELECT count(*) FROM embeddings), (SELECT unnest([0, 1, 2]) AS k)"


def embedding_dedup(least: float = 0.98, rows: str = "SELECT * FROM embeddings") -> str:
    return f"""
WITH RECURSIVE source AS ({rows}), v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM source WHERE label IS NOT NULL AND embedding IS NOT NULL),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= {least}),
reach AS (SELECT a AS id, b AS other FROM link UNION SELECT r.id, l.b FROM reach r JOIN link l ON l.a = r.other)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(first, vec_id)) AS component_id, vec_id <= coalesce(first, vec_id) AS kept
FROM source LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY 1) c USING (vec_id) LEFT JOIN (SELECT id AS vec_id, min(other) AS first FROM reach GROUP BY 1) r USING (vec_id)"""


def line_dedup(min_chars: int = 10) -> str:
    return f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS p FROM documents),
k AS (SELECT *, {LOWER.format(x=f"trim(line, {BLANKS})")} AS key FROM l),
d AS (SELECT key, min(doc_id) AS keep FROM k WHERE length(key) >= {min_chars} GROUP BY 1 HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.*, d.keep < doc_id AS gone FROM k LEFT JOIN d USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (gone IS NOT TRUE), '')) AS kept_sha256 FROM m GROUP BY 1"""


def vector_codes(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    nearest = "SELECT vec_id, part, min(list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * {n} + entry) AS best FROM parts p JOIN c{k} c USING (part) GROUP BY ALL"
    steps = [f"c0 AS MATERIALIZED (SELECT part, (row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1)::BIGINT AS entry, x FROM parts QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= {entries})"]
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED ({nearest.format(n=entries, k=k)})")
        if k < rounds:
            flat = f"SELECT part, best % {entries} AS entry, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{k} JOIN parts USING (vec_id, part)"
            means = f"SELECT part, entry, list(m ORDER BY i) AS x FROM (SELECT part, entry, i, floor(sum(v)::DOUBLE / count(*))::BIGINT AS m FROM ({flat}) GROUP BY ALL) GROUP BY ALL"
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN ({means}) m USING (part, entry))")
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS x FROM kept, (SELECT unnest(range({parts})) AS part)),
{", ".join(steps)},
coded AS (SELECT vec_id, string_agg(printf('%02x', best % {entries}), '' ORDER BY part) AS code, sum(best // {entries})::BIGINT AS error FROM a{rounds} GROUP BY 1),
digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, label, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), digest
"""


def phrases(least: int = 10, cover: int = 50, first: int = 2000) -> str:
    cut = lambda size, k: f"SELECT c.lang, c.phrase, c.a, {k} AS k, x.f AS l, y.f AS r FROM kept c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(string_split(c.phrase, ' ')[1:{k}], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(string_split(c.phrase, ' ')[{k + 1}:{size}], ' ') WHERE c.m = {size}"
    return rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER.format(x="coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, 1 AS m, unnest(ws) AS phrase FROM w
    UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w
    UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM w),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY 1),
c AS (SELECT lang, m, phrase, f AS a FROM f WHERE m > 1 AND f >= {least}),
longer AS (SELECT lang, array_to_string(string_split(phrase, ' ')[i : i + 1], ' ') AS phrase, max(a) AS a FROM c, (SELECT unnest([1, 2]) AS i) WHERE m = 3 GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN longer o USING (lang, phrase) WHERE coalesce(o.a, 0) * 100 < {cover} * c.a OR m = 3),
cuts AS ({cut(2, 1)} UNION ALL {cut(3, 1)} UNION ALL {cut(3, 2)}),
scored AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {first}
"""
