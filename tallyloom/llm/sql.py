"""SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from .op3_sharding import ROUNDS, _keys

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def groups_sql(n: int, num: int, den: int) -> str:
    """All pairs that share a shingle, their links, and what each document reaches."""
    shingle = "concat_ws(' ', " + ", ".join(f"w[i + {k}]" for k in range(n)) + ")"
    return f"""WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {n - 2}), lambda i: {shingle})) END g FROM t),
c AS (SELECT doc_id, CAST(len(g) AS bigint) n FROM s),
x AS (SELECT doc_id, unnest(g) h FROM s),
p AS (SELECT a.doc_id i, b.doc_id j, count(*) k FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT i, j FROM p JOIN c a ON a.doc_id = i JOIN c b ON b.doc_id = j WHERE {den} * k >= {num} * (a.n + b.n - k)),
e AS (SELECT i, j FROM l UNION ALL SELECT j, i FROM l),
r AS (SELECT doc_id a, doc_id b FROM c UNION SELECT r.a, e.j FROM r JOIN e ON e.i = r.b)
SELECT c.doc_id, c.n AS n_shingles, m.b AS component_id FROM c JOIN (SELECT a, min(b) b FROM r GROUP BY 1) m ON m.a = c.doc_id"""


OP9_SQL = groups_sql(4, 85, 100)


def _mixed(x: str) -> str:
    """The 64-bit mixing function on an unsigned 128-bit integer."""
    big = 1 << 64
    step = lambda v, shift: f"xor({v}, {v} // {1 << shift})"
    return f"list_reduce([{x}, 1::uhugeint, 2::uhugeint, 3::uhugeint], lambda a, k: CASE k WHEN 1 THEN {step('a', 30)} * {0xBF58476D1CE4E5B9}::uhugeint % {big}::uhugeint WHEN 2 THEN {step('a', 27)} * {0x94D049BB133111EB}::uhugeint % {big}::uhugeint ELSE {step('a', 31)} END)"


def shards_sql(shards: int, seed: int) -> str:
    """CRC-32 bit by bit over the UTF-8 bytes, then the keyed network with cycle walking as a recursion."""
    crc = "xor(4294967295, list_reduce(list_prepend(4294967295::bigint, bits), lambda a, e: xor(xor(a, e) >> 1, 3988292384 * (xor(a, e) & 1))))"
    rounds, left, right = [], "l", "r"
    for k, key in enumerate(_keys(seed)):
        rounds.append(f"n{k} AS (SELECT *, {right} l{k}, xor({left}, {_mixed(f'xor({right}, {int(key)}::uhugeint)')} % side) r{k} FROM {f'n{k - 1}' if k else 'h'})")
        left, right = f"l{k}", f"r{k}"
    assert len(rounds) == ROUNDS
    network = lambda source: f"WITH h AS (SELECT *, v // side l, v % side r FROM {source}), {', '.join(rounds)} SELECT i, n, side, {left} * side + {right} v FROM n{ROUNDS - 1}"
    return f"""WITH RECURSIVE b AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 8 AS bigint) size,
  list_transform(list_filter(string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1,0,0,0,0,0,0,0,', 'g'), ','), lambda x: x <> ''), lambda x: CASE WHEN x = '0' THEN 0 ELSE CAST('0x' || x AS bigint) END) bits FROM documents),
c AS (SELECT doc_id, size, {crc} text_crc32 FROM b),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 i, count(*) OVER () n FROM c),
z AS (SELECT i, n, CAST(power(2, greatest(1, (length(bin(greatest(n - 1, 1))) + 1) // 2)) AS uhugeint) side, CAST(i AS uhugeint) v FROM o),
w AS (SELECT * FROM ({network("z")}) UNION ALL SELECT * FROM ({network("(SELECT * FROM w WHERE v >= n)")}))
SELECT o.doc_id, o.size, o.text_crc32, 'rows' AS law, CAST(w.v % {shards} AS int) AS shard, CAST(w.v // {shards} AS bigint) AS slot, CAST(NULL AS int) AS grown_shard FROM o JOIN w ON w.i = o.i AND w.v < w.n"""


OP3_SQL = shards_sql(24, 20240229)


def search_sql(k: int) -> str:
    """All terms of all documents, and the sum of impacts of every document and item that share one."""
    terms = lambda c: f"regexp_extract_all(translate(coalesce({c}, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""WITH d AS (SELECT doc_id, {terms("text")} w FROM documents),
t AS (SELECT doc_id, unnest(w) term FROM d),
p AS (SELECT doc_id, term, count(*) tf FROM t GROUP BY 1, 2),
n AS (SELECT doc_id, CAST(len(w) AS bigint) n FROM d WHERE len(w) > 0),
s AS (SELECT count(*) docs, CAST(sum(n) AS bigint) total FROM n),
f AS (SELECT term, count(*) df FROM p GROUP BY 1),
v AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS double) / CAST(2 * df + 1 AS double))) AS bigint) w FROM f, s),
i AS (SELECT DISTINCT item_id, unnest({terms("text")}) term FROM benchmark),
m AS (SELECT doc_id, 50 + ((50 * n * docs) // total) m FROM n, s),
c AS (SELECT i.item_id, p.doc_id, CAST(sum(v.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * m.m))) AS bigint) score FROM i JOIN p ON p.term = i.term JOIN v ON v.term = i.term JOIN m ON m.doc_id = p.doc_id GROUP BY 1, 2),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS int) AS rank, doc_id, score FROM c WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {k}"""


OP12_SQL = search_sql(50)
