"""The operators' results as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = "regexp_extract_all(" + LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op1_decontamination"] = f"""
WITH item AS (SELECT item_id, {WORDS.format("text")} AS w FROM benchmark),
win AS (
    SELECT DISTINCT item_id, w[s:s + 12] AS g
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents),
lens AS (SELECT DISTINCT len(g) AS n FROM win),
cand AS (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM doc, lens WHERE len(w) >= n),
hit AS (
    SELECT cand.doc_id, cand.s, cand.n, win.item_id
    FROM cand JOIN win ON cand.w[cand.s:cand.s + cand.n - 1] = win.g),
pos AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM hit)) GROUP BY doc_id),
its AS (
    SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
    coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

# The CRC-32 of four zero bits behind each value of four bits.
CRC_NIBBLES = [v for v in range(16)]
for _ in range(4):
    CRC_NIBBLES = [(v >> 1) ^ (3988292384 if v & 1 else 0) for v in CRC_NIBBLES]

# The square's side, the four rounds and the walk of the sharding permutation.
ORACLE_SQL["op6_sharding"] = f"""
WITH RECURSIVE doc AS (
    SELECT doc_id, (strlen(coalesce(text, '')) + 1)::BIGINT AS size, hex(coalesce(text, '')) AS h FROM documents),
summed AS (
    SELECT doc_id, size, CASE WHEN size = 1 THEN 0 ELSE xor(4294967295::UBIGINT, list_reduce(list_transform(
        string_split(regexp_replace(h, '(.)(.)', '\\2\\1', 'g'), ''), lambda c: (instr('0123456789ABCDEF', c) - 1)::UBIGINT),
        lambda a, b: xor(a >> 4, {CRC_NIBBLES}[1 + (xor(a, b) & 15)::BIGINT]), 4294967295::UBIGINT))::BIGINT END AS text_crc32
    FROM doc),
num AS (
    SELECT *, row_number() OVER (ORDER BY substr(md5(coalesce(doc_id::VARCHAR, 'null:' || text_crc32)), 1, 3),
        doc_id NULLS FIRST, text_crc32, size) - 1 AS x, count(*) OVER () AS n,
        ceil(sqrt(count(*) OVER ()))::BIGINT AS side FROM summed),
walk(x0, n, side, y, l, r, turn) AS (
    SELECT x, n, side, -1::BIGINT, x // side, x % side, 0 FROM num
    UNION ALL
    SELECT x0, n, side,
        CASE WHEN turn = 4 THEN l * side + r ELSE -1 END,
        CASE WHEN turn = 4 THEN (l * side + r) // side ELSE r END,
        CASE WHEN turn = 4 THEN (l * side + r) % side
            ELSE (l + ('0x' || substr(md5('17:' || (turn + 1) || ':' || r), 1, 12))::BIGINT) % side END,
        CASE WHEN turn = 4 THEN 0 ELSE turn + 1 END
    FROM walk WHERE y < 0 OR y >= n),
place AS (SELECT x0, y FROM walk WHERE y >= 0 AND y < n)
SELECT doc_id, size, text_crc32, 'rows' AS law, (y % 8)::INTEGER AS shard, (y // 8)::BIGINT AS slot,
    NULL::INTEGER AS grown_shard
FROM num JOIN place ON num.x = place.x0
"""

ORACLE_SQL["op8_chat_format"] = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
said AS (
    SELECT conv_id, count(*)::BIGINT AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS spoken,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS learnt,
        sum(length(role) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 18)::BIGINT AS formatted_chars,
        string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, ''
            ORDER BY turn NULLS FIRST, role, text) AS roles
    FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(spoken) AS turns_sha256, length(learnt)::BIGINT AS loss_chars,
    sha256(learnt) AS loss_sha256, formatted_chars, regexp_full_match(roles, 's?(ua)*u?') AS valid
FROM said
"""

ORACLE_SQL["op9_exact_dedup"] = r"""
WITH norm AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
    doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM norm WINDOW same AS (PARTITION BY t)
"""

# All pairs of sets that share a shingle, and what can be reached over those that link.
COMPONENTS = r"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all({lower}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
    SELECT DISTINCT doc_id, s
    FROM (SELECT doc_id, unnest(CASE WHEN len(w) < 4 THEN [w] ELSE [w[i:i + 3] FOR i IN range(1, len(w) - 2)] END) AS s
          FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
    FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (
    SELECT a, b FROM pair JOIN size x ON a = x.doc_id JOIN size y ON b = y.doc_id
    WHERE 100 * c >= {percent} * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, root) AS (
    SELECT doc_id, doc_id FROM doc
    UNION SELECT both_ways.b, root FROM reach JOIN both_ways ON reach.doc_id = both_ways.a),
least AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id{more}
FROM doc LEFT JOIN size USING (doc_id) LEFT JOIN least USING (doc_id)
"""
ORACLE_SQL["op3_ngram_join"] = COMPONENTS.format(lower=LOWER.format("text"), percent=85, more="")
ORACLE_SQL["op11_minhash_dedup"] = COMPONENTS.format(
    lower=LOWER.format("text"), percent=80, more=", doc_id = component_id AS kept"
)

ORACLE_SQL["op12_fill_in_middle"] = r"""
WITH doc AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s,
        regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t FROM documents),
drawn AS (
    SELECT doc_id, text, t, len(t) AS n, [('0x' || substr(s, 8 * i + 1, 8))::BIGINT FOR i IN range(4)] AS h FROM doc),
cut AS (
    SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90
            THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
piece AS (
    SELECT *, array_to_string(t[1:a], '') AS p, array_to_string(t[a + 1:b], '') AS m, array_to_string(t[b + 1:n], '') AS e FROM cut)
SELECT doc_id, n::BIGINT AS n, form,
    CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || e || '<M>' || m
        ELSE '<S>' || e || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM piece
"""

# The CRC-32 of a string from the hex digits of its bytes, low digit of each byte first.
CRC = (
    "xor(4294967295::UBIGINT, list_reduce(list_transform(string_split(regexp_replace(hex({}), '(.)(.)', '\\2\\1', 'g'), ''), "
    "lambda c: (instr('0123456789ABCDEF', c) - 1)::UBIGINT), "
    f"lambda a, b: xor(a >> 4, {CRC_NIBBLES}[1 + (xor(a, b) & 15)::BIGINT]), 4294967295::UBIGINT))::BIGINT"
)
ORACLE_SQL["op13_spelling_variants"] = f"""
WITH RECURSIVE run AS (
    SELECT doc_id, r, count(*) AS c
    FROM (SELECT doc_id, unnest(regexp_extract_all({LOWER.format("text")}, '[A-Za-z\u00C0-\u00FF]+')) AS r FROM documents)
    WHERE length(r) >= 7 GROUP BY doc_id, r),
drawn AS (SELECT r, c, {CRC.format("coalesce(doc_id::VARCHAR, '') || ':' || r")} AS h FROM run),
word AS (
    SELECT w, sum(c)::BIGINT AS n
    FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, (h % length(r))::BIGINT) || substr(r, (h % length(r))::BIGINT + 2) ELSE r END AS w, c FROM drawn)
    WHERE length(w) >= 7 GROUP BY w HAVING sum(c) >= 2),
gap AS (SELECT w, n, i, substr(w, 1, i - 1) || substr(w, i + 1) AS g FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM word)),
pair AS (
    SELECT a.w AS a, b.w AS b FROM gap a JOIN gap b ON a.i = b.i AND a.g = b.g AND a.w <> b.w
    UNION SELECT gap.w, word.w FROM gap JOIN word ON gap.g = word.w
    UNION SELECT word.w, gap.w FROM gap JOIN word ON gap.g = word.w),
near AS (
    SELECT a, count(*) AS n_near, max(word.n) AS most, arg_min(b, struct_pack(x := -word.n, y := b)) AS b
    FROM pair JOIN word ON pair.b = word.w GROUP BY a),
formed AS (
    SELECT w, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN most >= 10 * n THEN b END AS form,
        CASE WHEN most >= 10 * n THEN most END AS form_n FROM word LEFT JOIN near ON w = a),
chain(w, here, step) AS (
    SELECT w, w, 0 FROM formed
    UNION ALL SELECT chain.w, formed.form, step + 1 FROM chain JOIN formed ON chain.here = formed.w WHERE formed.form IS NOT NULL),
last AS (SELECT w, arg_max(here, step) AS root FROM chain GROUP BY w)
SELECT w AS word, form, root, n, n_near, form_n FROM formed JOIN last USING (w)
"""
