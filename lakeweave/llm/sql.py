"""SQL (DuckDB) with the rows of a query, where SQL can express them."""

NEAR_DEDUP = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents
), sets AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []
        WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
    FROM words
), each AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id
    HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM sets
    UNION
    SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), smallest AS (
    SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN smallest ON doc_id = a
"""

DECONTAMINATION = r"""
WITH doc_words AS (
    SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents WHERE doc_id IS NOT NULL
), item_words AS (
    SELECT DISTINCT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS v
    FROM benchmark WHERE item_id IS NOT NULL
), masks(m, picked) AS (
    VALUES (0, [0, 1, 2, 3, 8, 9, 10, 11]), (1, [0, 1, 3, 4, 6, 7, 9, 10]), (2, [0, 2, 4, 5, 6, 7, 9, 11])
), doc_windows AS (
    SELECT doc_id, unnest(range(0, len(w) - 11)) AS pos, w FROM doc_words
), item_windows AS (
    SELECT item_id, unnest(range(0, len(v) - 11)) AS pos, v FROM item_words
), doc_seeds AS (
    SELECT doc_id, pos, m, list_transform(picked, lambda k: w[pos + k + 1]) AS seed FROM doc_windows, masks
), item_seeds AS (
    SELECT item_id, pos, m, list_transform(picked, lambda k: v[pos + k + 1]) AS seed FROM item_windows, masks
), hits AS (
    SELECT DISTINCT doc_id, item_id, d.pos - i.pos AS shift
    FROM doc_seeds d JOIN item_seeds i ON d.m = i.m AND d.seed = i.seed
), aligned AS (
    SELECT doc_id, item_id, shift, w, v,
        unnest(range(greatest(shift, 0), least(len(w), shift + len(v)))) AS pos
    FROM hits JOIN doc_words USING (doc_id) JOIN item_words USING (item_id)
), sums AS (
    SELECT doc_id, item_id, shift, pos, sum(CASE WHEN w[pos + 1] = v[pos - shift + 1] THEN 1 ELSE -2 END)
        OVER (PARTITION BY doc_id, item_id, shift ORDER BY pos) AS s
    FROM aligned
), runs AS (
    SELECT doc_id, item_id, shift, s - least(0, coalesce(min(s)
        OVER (PARTITION BY doc_id, item_id, shift ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS run
    FROM sums
), scored AS (
    SELECT doc_id, item_id, shift, max(run) AS score FROM runs GROUP BY ALL HAVING max(run) >= 12
)
SELECT doc_id, item_id, CAST(max(score) AS INTEGER) AS overlap_score, count(*) AS n_alignments
FROM scored GROUP BY doc_id, item_id
"""

# Letters À to ÿ take two bytes in UTF-8; the table of the checksum comes from its polynomial.
SPELLING = r"""
WITH RECURSIVE crc_table AS (
    SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), runs AS (
    SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), counted AS (
    SELECT doc_id, run, count(*) AS c FROM runs GROUP BY doc_id, run
), hashed AS (
    SELECT run, c, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(
            list_transform(string_split(CAST(doc_id AS VARCHAR) || ':' || run, ''), lambda x: unicode(x)::BIGINT),
            lambda u: CASE WHEN u < 128 THEN [u] ELSE [195, u - 64] END))),
        lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h
    FROM counted, crc_table
), words AS (
    SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word,
        CAST(sum(c) AS BIGINT) AS n
    FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(c) >= 3
), places AS (
    SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words
), gaps AS (
    SELECT word, n, left(word, i - 1) AS l, substr(word, i + 1) AS r FROM places
), near AS (
    SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM gaps a JOIN gaps b ON a.l = b.l AND a.r = b.r AND a.word <> b.word
    UNION
    SELECT g.word, g.n, w.word, w.n FROM gaps g JOIN words w ON g.l || g.r = w.word
    UNION
    SELECT w.word, w.n, g.word, g.n FROM gaps g JOIN words w ON g.l || g.r = w.word
), best AS (
    SELECT word, count(*) AS n_near, max(other_n) AS top FROM near GROUP BY word
), forms AS (
    SELECT near.word, min(other) AS form, any_value(top) AS form_n
    FROM near JOIN best ON near.word = best.word AND other_n = top WHERE top >= 2 * n GROUP BY near.word
), chain AS (
    SELECT word, form AS root FROM forms
    UNION
    SELECT chain.word, forms.form FROM chain JOIN forms ON chain.root = forms.word
), roots AS (
    SELECT word, root FROM chain WHERE root NOT IN (SELECT word FROM forms)
)
SELECT word, form, coalesce(root, word) AS root, n, coalesce(n_near, 0) AS n_near, form_n
FROM words LEFT JOIN best USING (word) LEFT JOIN forms USING (word) LEFT JOIN roots USING (word)
"""

ORACLE_SQL = {
    "op2_decontamination": DECONTAMINATION,
    "op7_minhash_near_dedup": NEAR_DEDUP,
    "op11_spelling_variants": SPELLING,
}
