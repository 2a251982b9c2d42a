"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = r"[\x20\x09-\x0D]+"

#: Shingles as text, all pairs with a common one, components by least id.
OP1 = rf"""
WITH RECURSIVE words AS (
 SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_SPACE}'), lambda x: x <> '') AS w FROM documents),
sh AS (
 SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS u, b.doc_id AS w, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT u, w FROM common JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = w WHERE 100 * k >= 75 * (a.n + b.n - k)),
cc(id, root) USING KEY (id) AS (
 SELECT doc_id, doc_id FROM words
 UNION
 SELECT e.u, min(cc.root) FROM cc JOIN e ON e.w = cc.id JOIN recurring.cc r ON r.id = e.u WHERE cc.root < r.root GROUP BY e.u)
SELECT doc_id, coalesce(n, 0) AS n_shingles, (SELECT count(*) FROM e WHERE u = doc_id) AS n_links, root AS component_id FROM words LEFT JOIN n USING (doc_id) JOIN cc ON cc.id = doc_id"""

OP5 = r"""
WITH rows AS (
 SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(i)),
marked AS (
 SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after, row_number() OVER w AS k FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
sized AS (
 SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|/?SYS\]|/?ANS\]|NEXT\]|ROLE\]|:\])', '\1\\\2\3', 'g'))
  + CASE WHEN before IS DISTINCT FROM role THEN CASE role WHEN 'system' THEN 6 WHEN 'user' THEN 7 WHEN 'assistant' THEN 6 ELSE 10 + length(role) END ELSE 6 END
  + CASE WHEN after IS DISTINCT FROM role THEN 4 ELSE 0 END AS chars FROM marked)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(3 + sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""

#: All pairs of equal lines, their diagonals' runs of 50 words, and what of those doesn't lie in the earlier run.
OP7 = r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls, text IS NULL AS none FROM documents),
raw AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM split),
worded AS (SELECT doc_id, pos, trim(translate(line, chr(9) || chr(11) || chr(12) || chr(13), '    ')) AS line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM raw),
seq AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM worded WHERE w > 0),
pairs AS (SELECT b.doc_id AS d, a.doc_id AS o, b.k - a.k AS shift, b.k, b.pos, b.w FROM seq a JOIN seq b ON a.line = b.line AND (a.doc_id < b.doc_id OR a.doc_id = b.doc_id AND a.k < b.k)),
diagonal AS (SELECT *, k - row_number() OVER (PARTITION BY d, o, shift ORDER BY k) AS g FROM pairs),
common AS (SELECT *, sum(w) OVER (PARTITION BY d, o, shift, g ORDER BY k) AS upto, max(k) OVER (PARTITION BY d, o, shift, g) AS e FROM diagonal),
gone AS (
 SELECT DISTINCT s.d AS doc_id, s.k FROM common s JOIN common t ON t.d = s.d AND t.o = s.o AND t.shift = s.shift AND t.g = s.g
  AND t.k = CASE WHEN s.d = s.o THEN least(s.e, s.k + s.shift - 1) ELSE s.e END WHERE t.upto >= 50),
worn AS (SELECT doc_id, pos, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS g FROM gone JOIN seq USING (doc_id, k)),
runs AS (SELECT doc_id, min(pos) AS first, max(pos) AS last FROM worn GROUP BY doc_id, g),
dead AS (SELECT raw.doc_id, raw.pos FROM runs JOIN raw ON raw.doc_id = runs.doc_id AND raw.pos BETWEEN first AND last),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM raw ANTI JOIN dead USING (doc_id, pos) GROUP BY doc_id),
merged AS (SELECT doc_id, min(pos) AS first, max(pos) AS last FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM dead) GROUP BY doc_id, g)
SELECT doc_id, CASE WHEN none THEN 0 ELSE CAST(len(ls) AS INT) END AS n_lines, CAST((SELECT count(*) FROM dead d WHERE d.doc_id = s.doc_id) AS INT) AS n_removed,
 coalesce((SELECT string_agg(first || '-' || last, ',' ORDER BY first) FROM merged r WHERE r.doc_id = s.doc_id), '') AS removed_runs,
 CAST(length(coalesce(k.text, '')) AS INT) AS kept_chars, sha256(coalesce(k.text, '')) AS kept_sha256
FROM split s LEFT JOIN kept k USING (doc_id)"""

OP9 = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
e AS (SELECT a.vec_id AS u, b.vec_id AS w FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
cc(id, root) USING KEY (id) AS (
 SELECT vec_id, vec_id FROM v
 UNION
 SELECT e.u, min(cc.root) FROM cc JOIN e ON e.w = cc.id JOIN recurring.cc r ON r.id = e.u WHERE cc.root < r.root GROUP BY e.u)
SELECT vec_id, (SELECT count(*) FROM e WHERE u = vec_id) AS n_links, root AS component_id, vec_id = root AS kept FROM v JOIN cc ON cc.id = vec_id"""



def _overlaps() -> str:
    """All common seeds, every stretch between two matches of their diagonals, and the longest ones."""
    masks = ((0, 1, 2, 3, 4), (0, 1, 3, 5, 6), (0, 2, 3, 5, 7), (0, 1, 4, 6, 7), (0, 1, 2, 4, 5))
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"

    def keyed(table: str, name: str, mask: tuple[int, ...]) -> str:
        key = " || ' ' || ".join(f"w[i + {m + 1}]" for m in mask)
        return f"(SELECT {name}, i, {key} AS key FROM {table}, unnest(range(len(w) - {mask[-1]})) r(i))"

    hits = " UNION ".join(f"SELECT doc_id, item_id, d.i - b.i AS shift FROM {keyed('docs', 'doc_id', m)} d JOIN {keyed('items', 'item_id', m)} b USING (key)" for m in masks)
    return f"""
WITH docs AS (SELECT doc_id, {words} AS w FROM documents),
items AS (SELECT item_id, {words} AS w FROM benchmark),
hits AS ({hits}),
same AS (SELECT doc_id, item_id, shift, q, len(items.w) AS n, row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY q) AS k
 FROM hits JOIN docs USING (doc_id) JOIN items USING (item_id), unnest(range(len(items.w))) r(q) WHERE q + shift >= 0 AND docs.w[q + shift + 1] = items.w[q + 1]),
runs AS (SELECT a.doc_id, a.item_id, a.shift, a.q AS start, b.q - a.q + 1 AS words, b.k - a.k + 1 AS matches, a.n FROM same a JOIN same b USING (doc_id, item_id, shift) WHERE b.k >= a.k AND b.k - a.k + 1 >= 0.8 * (b.q - a.q + 1) - 1e-9),
longest AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY words DESC, start) AS r FROM runs),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matches DESC, shift) AS s FROM longest WHERE r = 1 AND words >= least(13, n))
SELECT doc_id, item_id, start + shift AS doc_word, start AS item_word, words AS n_words, matches AS n_matches FROM best WHERE s = 1
UNION ALL
SELECT doc_id, item_id, 0, 0, len(docs.w), len(docs.w) FROM docs JOIN items ON docs.w = items.w WHERE len(docs.w) BETWEEN 1 AND 4"""


ORACLES = {"op1_ngram_jaccard_join": OP1, "op5_chat_formatting": OP5, "op7_line_dedup": OP7, "op9_embedding_near_dedup": OP9, "op10_decontamination": _overlaps()}

_OP11_UNITS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"

#: Units as lists, cut by list slices.
OP11 = rf"""
WITH cut AS (
 SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_OP11_UNITS}') AS u, sha256('42:' || doc_id) AS h FROM documents),
drawn AS (
 SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS c1, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS c2,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain' WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM cut),
parts AS (
 SELECT *, array_to_string(u[1:least(c1, c2)], '') AS p, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m, array_to_string(u[greatest(c1, c2) + 1:], '') AS s FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts"""


def _op13(rounds: int = 10) -> str:
    """Whole distances to all centroids, round by round; a centroid is a list."""
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (
 SELECT k.row, k.vec_id, k.w, min(struct_pack(d := list_sum(list_transform(list_zip(k.w, c.w), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, j := c.j)) AS b FROM kept k, c{r} c GROUP BY ALL)"""
        )
        if r < rounds:
            steps.append(
                f"""c{r + 1} AS MATERIALIZED (
 SELECT c.j, coalesce(m.w, c.w) AS w FROM c{r} c LEFT JOIN (
  SELECT j, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS w FROM (
   SELECT b.j AS j, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT b, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM a{r}) GROUP BY ALL) GROUP BY j) m USING (j))"""
            )
    return f"""
WITH kept AS MATERIALIZED (
 SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS w FROM embeddings
 WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, w) - 1 AS j, w FROM (SELECT sha256('3:' || vec_id) AS h, w FROM kept ORDER BY h, w LIMIT 8)),
{", ".join(steps)}
SELECT vec_id, b.j::INTEGER AS cluster, b.d AS distance, (sum(b.d) OVER (PARTITION BY b.j))::BIGINT AS cluster_inertia, (sum(b.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.w, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.j = a.b.j"""


ORACLES["op11_fill_in_middle"] = OP11
ORACLES["op13_centroid_clustering"] = _op13()
