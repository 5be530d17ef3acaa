"""DuckDB SQL for the operators that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Windows of 13 words (an item of fewer is one window), their occurrences in documents, and the words those cover.
OP8 = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS g
       FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT r, i, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g FROM d, ms, unnest(range(1, greatest(len(w) - m + 2, 1))) AS t(i)),
h AS (SELECT r, i, dw.m AS m, item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.g = bw.g),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT r, i, m FROM h)) GROUP BY r),
n AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM h GROUP BY r)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN n USING (r)
"""

OP10 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS s FROM pages),
l AS (SELECT *, octet_length(b) AS n, max(page_id) OVER (PARTITION BY s) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, s AS payload_digest,
       CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM top AND top IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM top THEN top END AS refers_to,
       CAST(CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM top AND top IS NOT NULL THEN 1 ELSE greatest(1, ceil(n / 65536.0)) END AS BIGINT) AS n_chunks
FROM l
"""

#: All pairs by brute force: shingles shared by two different sets, links, and the components by recursion.
OP9 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_sort(list_distinct([array_to_string(list_slice(w, i, i + 2), ' ') for i in range(1, len(w) - 1)])) END AS g FROM d),
u AS (SELECT min(doc_id) AS id, g, len(g) AS n FROM s WHERE len(g) > 0 GROUP BY g),
e AS (SELECT id, n, unnest(g) AS x FROM u),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.x = b.x AND a.id < b.id AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n) GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 190 * i >= 90 * (na + nb)),
b2 AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT id AS node, id AS root FROM u UNION SELECT b2.b, r.root FROM r JOIN b2 ON b2.a = r.node),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, coalesce(c.root, s.doc_id) AS component_id
FROM s LEFT JOIN u ON s.g = u.g LEFT JOIN c ON c.node = u.id
"""

#: The same digests, ranks and cuts by windows over the whole table; crc is the table of CRC-32, byte by byte.
OP11 = """
WITH t AS (SELECT [list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, 3988292384 * (c & 1))) for i in range(0, 256)] AS crc),
k AS (SELECT doc_id, coalesce('s' || source, 'n') AS stratum, coalesce(text, '') AS text,
      md5(concat_ws(':', 'interleave-1', coalesce('d' || doc_id, 'n'), coalesce('s' || source, 'n'), md5(coalesce(text, '')))) AS key FROM documents),
c AS (SELECT *, row_number() OVER (PARTITION BY key) AS copy FROM k),
o AS (SELECT *, md5(concat_ws(':', 'interleave-1', key, copy)) AS turn FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY turn, key, copy) - 1 AS r, count(*) OVER (PARTITION BY stratum) AS n,
      (('0x' || md5(concat_ws(':', 'interleave-1', stratum))[:5])::BIGINT + 0.5::DOUBLE) / 1048576::DOUBLE AS u FROM o),
p AS (SELECT *, row_number() OVER (ORDER BY (r + u) / n, stratum, turn, key, copy) - 1 AS pos, count(*) OVER () AS rows FROM r),
b AS (SELECT *, CAST(pos * 16 // rows AS INTEGER) AS shard FROM p)
SELECT doc_id, CAST(strlen(text) + 1 AS BIGINT) AS size,
       CAST(xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)),
            lambda a, x: xor(a >> 8, t.crc[CAST(xor(a & 255, x) AS INTEGER) + 1])), 4294967295) AS BIGINT) AS text_crc32,
       'rows' AS law, shard, pos - (shard * rows + 15) // 16 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM b, t
"""


def _path(state: str, cost: str, letter: str, line: str) -> str:
    """A path of edits (cost c, letters a, repaired lines t) with one more; null where there is no path."""
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t || {line}}} END"


def _kept(state: str, initial: str) -> str:
    return f"CASE WHEN NOT q.go AND q.i = '{initial}' THEN {_path(state, 'q.x', 'K', "chr(10) || q.role || ':' || q.text")} END"


def _anew(state: str, role: str) -> str:
    return f"CASE WHEN NOT q.go THEN {_path(state, '3 + q.x', 'R', f"chr(10) || '{role}:' || q.text")} END"


def _gone(state: str) -> str:
    return _path(state, "4", "D", "''")


def _inserted(state: str, role: str) -> str:
    return _path(state, "3", "I", f"chr(10) || '{role}:'")


def _with_inserts(paths: str) -> str:
    users, replies = ", ".join(_inserted(f"v[{s}]", "user") for s in (1, 2, 4)), _inserted("v[3]", "assistant")
    return f"list_transform([{paths}], lambda v: [v[1], v[2], list_min([v[3], {users}]), list_min([v[4], {replies}])])[1]"


_USER = ", ".join([*(_kept(f"b[{s}]", "u") for s in (1, 2, 4)), *(_anew(f"b[{s}]", "user") for s in (1, 2, 4))])
_NO_PATH = "{'b': [NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR)], 'i': '', 'role': '', 'text': '', 'go': NULL, 'x': 0}"
_CRC_TABLE = "[list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, 3988292384 * (c & 1))) for i in range(0, 256)]"


def _crc32(text: str) -> str:
    """CRC-32 of a string, byte by byte, with the table t.crc."""
    return f"""xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)),
            lambda a, x: xor(a >> 8, t.crc[CAST(xor(a & 255, x) AS INTEGER) + 1])), 4294967295)"""


#: The least path to each of four states, turn by turn; the first and last item of the list carry the start and the closing inserts.
OP13 = f"""
WITH t AS (SELECT {_CRC_TABLE} AS crc),
z AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
      {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k FROM conversations, t),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
      CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM z WHERE k <> 0),
f AS (SELECT *, rtrim(text, E'\\t\\n\\x0b\\f\\r ') AS cut, row_number() OVER w AS r, left(role, 1) AS i, lag(left(role, 1)) OVER w AS before
      FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY r) AS seen FROM f),
g AS (SELECT *, cut = '' AS blank, cut <> '' AND seen > 1 AS duplicate, cut <> '' AND seen = 1 AND right(cut, 1) NOT IN ('.', '!', '?') AS truncated FROM e),
h AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::INT) AS blank, sum(duplicate::INT) AS duplicate, sum(truncated::INT) AS truncated,
      sum((before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au'))::INT) AS illegal,
      list({{'i': i, 'role': role, 'text': text, 'go': blank OR duplicate, 'x': CASE WHEN truncated THEN 3 ELSE 0 END}} ORDER BY r) AS rows FROM g GROUP BY conv_id),
s AS (SELECT *, list_reduce(list_prepend({{'b': [{{'c': 0, 'a': '', 't': ''}}, NULL, NULL, NULL], 'i': '', 'role': '', 'text': '', 'go': NULL, 'x': 0}},
        list_append(list_transform(rows, lambda q: {{'b': [NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR)], 'i': q.i, 'role': q.role, 'text': q.text, 'go': q.go, 'x': q.x}}), {_NO_PATH})),
      lambda p, q: {{'b': list_transform([{_with_inserts(_with_inserts("p.b"))}], lambda b: CASE WHEN q.go IS NULL THEN b ELSE [
        {_gone("b[1]")},
        list_min([{_gone("b[2]")}, {_kept("b[1]", "s")}]),
        list_min([{_gone("b[3]")}, {_USER}]),
        list_min([{_gone("b[4]")}, {_kept("b[3]", "a")}, {_anew("b[3]", "assistant")}])] END)[1],
      'i': '', 'role': '', 'text': '', 'go': NULL, 'x': 0}}).b AS b FROM h),
m AS (SELECT *, list_min([b[1], b[4]]) AS w FROM s)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(w.c, 0) AS BIGINT) AS cost,
       coalesce(w.a, '') AS audit, sha256(coalesce(w.t[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN m ON o.conv_id IS NOT DISTINCT FROM m.conv_id
"""


_PIECES = rf"regexp_split_to_array(replace({_LOWER}, chr(9), ' '), '[.,;:!?\x0A-\x0D]')"

#: All phrases of 1 to 5 words by brute force.
OP12 = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest({_PIECES}) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ ]+') AS w FROM p),
f AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM w, unnest(range(1, 6)) AS x(m), unnest(range(1, greatest(len(w) - m + 2, 1))) AS y(i) GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 100),
k AS (SELECT c.lang, c.phrase, c.f AS a, k, l.f AS l, r.f AS r, CAST(n AS BIGINT) AS n, CAST((1000::HUGEINT * c.f * n::HUGEINT) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
      FROM c JOIN n USING (lang), unnest(range(1, m)) AS t(k)
      JOIN f l ON l.lang = c.lang AND l.m = k AND l.phrase = array_to_string(w[:k], ' ') JOIN f r ON r.lang = c.lang AND r.m = c.m - k AND r.phrase = array_to_string(w[k + 1:], ' ')),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
g AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.f >= b.a AND c.m > len(string_split(b.phrase, ' ')) AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM g QUALIFY rank <= 2000
"""

SQL = {"op9_jaccard_join": OP9, "op8_decontaminate": OP8, "op10_warc_chunks": OP10, "op11_stratified_shards": OP11, "op12_collocations": OP12, "op13_conversation_repair": OP13}
