"""Building blocks of DuckDB SQL that the oracles share, BLAKE2b in plain SQL among them."""

from __future__ import annotations

from siftmark.functions.hashing import PRIME, hyperplanes

#: Initial words and message order of BLAKE2b (RFC 7693).
IV = [0x6A09E667F3BCC908, 0xBB67AE8584CAA73B, 0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1, 0x510E527FADE682D1, 0x9B05688C2B3E6C1F, 0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179]
SIGMA = [
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15],
    [14, 10, 4, 8, 9, 15, 13, 6, 1, 12, 0, 2, 11, 7, 5, 3],
    [11, 8, 12, 0, 5, 2, 15, 13, 10, 14, 3, 6, 7, 1, 9, 4],
    [7, 9, 3, 1, 13, 12, 11, 14, 2, 6, 5, 10, 4, 0, 15, 8],
    [9, 0, 5, 7, 2, 4, 10, 15, 14, 1, 11, 12, 6, 8, 3, 13],
    [2, 12, 6, 10, 0, 11, 8, 3, 4, 13, 7, 5, 15, 14, 1, 9],
    [12, 5, 1, 15, 14, 13, 4, 10, 0, 7, 6, 3, 9, 2, 8, 11],
    [13, 11, 7, 14, 12, 1, 3, 9, 5, 0, 15, 4, 8, 6, 2, 10],
    [6, 15, 14, 9, 11, 3, 0, 8, 12, 2, 13, 7, 1, 4, 10, 5],
    [10, 2, 8, 4, 7, 6, 1, 5, 15, 11, 9, 14, 3, 12, 13, 0],
]
LANES = [[(0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15)], [(0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14)]]
TWO64 = "18446744073709551616"


def _swap(hex_digits: str) -> str:
    return " || ".join(f"substr({hex_digits}, {15 - 2 * k}, 2)" for k in range(8))


def _number(hex_digits: str) -> str:
    return f"('0x' || {hex_digits})::UBIGINT"


def _plus(*terms: str) -> str:
    return f"(({' + '.join(f'{t}::UHUGEINT' for t in terms)}) % {TWO64})::UBIGINT"


def _rotate(x: str, n: int) -> str:
    return f"(({x} >> {n}) | (({x} & {(1 << n) - 1}::UBIGINT) << {64 - n}))"


def blake2b8(source: str) -> str:
    """SELECT of ``s`` and ``h`` (UBIGINT) for the strings ``s`` of a relation, of 128 bytes or fewer."""
    return f"SELECT s, h0 AS h FROM ({blake2b(source, 8)})"


def blake2b(source: str, size: int) -> str:
    """SELECT of ``s, h0`` and, for a digest of 16 bytes, ``h1``: its words, big-endian."""
    digits = "rpad(lower(hex(encode(s))), 256, '0')"
    words = ", ".join(f"{_number('(' + _swap(f'substr(x, {16 * i + 1}, 16)') + ')')} AS m{i}" for i in range(16))
    start = [IV[0] ^ 0x01010000 ^ size, *IV[1:]]
    before = ", ".join(f"{v}::UBIGINT AS h{i}" for i, v in enumerate(start))
    sql = _block(f"SELECT s, {words}, {before} FROM (SELECT s, {digits} AS x FROM {source})", "octet_length(encode(s))", True)
    words = range(size // 8)
    out = ", ".join(f"printf('%016x', h{i}) AS y{i}" for i in words)
    return "SELECT s, " + ", ".join(f"{_number('(' + _swap(f'y{i}') + ')')} AS h{i}" for i in words) + f" FROM (SELECT s, {out} FROM ({sql}))"


def blake2b4_doubles(source: str, n: int) -> str:
    """SELECT of ``hex``: four bytes over ``n`` doubles, little-endian, of the one list ``v`` of a relation; n is a multiple of 16."""
    start = [IV[0] ^ 0x01010000 ^ 4, *IV[1:]]
    sql = f"SELECT v, {', '.join(f'{x}::UBIGINT AS h{i}' for i, x in enumerate(start))} FROM {source}"
    for at in range(0, n, 16):
        words = ", ".join(f"v[{at + i + 1}]::DOUBLE::BIT::UBIGINT AS m{i}" for i in range(16))
        sql = _block(f"SELECT v, {words}, {', '.join(f'h{i}' for i in range(8))} FROM ({sql})", str(8 * (at + 16)), at + 16 == n)
    return f"SELECT substr({_swap('y')}, 1, 8) AS hex FROM (SELECT printf('%016x', h0) AS y FROM ({sql}))"


def _block(sql: str, length: str, last: bool) -> str:
    """A relation with message words ``m0..m15`` and state ``h0..h7``, its state one block further."""
    state = [f"h{i}" for i in range(8)] + [f"{v}::UBIGINT" for v in IV]
    state[12] = f"xor({state[12]}, ({length})::UBIGINT)"
    if last:
        state[14] = f"{IV[6] ^ ((1 << 64) - 1)}::UBIGINT"
    sql = f"SELECT *, {', '.join(f'{v} AS v{i}' for i, v in enumerate(state))} FROM ({sql})"
    for r in range(12):
        order = SIGMA[r % 10]
        for phase, lanes in enumerate(LANES):
            for half, (turn_d, turn_b) in enumerate(((32, 24), (16, 63))):
                m = [f"m{order[8 * phase + 2 * k + half]}" for k in range(4)]
                for step in range(4):
                    changed = []
                    for k, (a, b, c, d) in enumerate(lanes):
                        a, b, c, d = f"v{a}", f"v{b}", f"v{c}", f"v{d}"
                        changed.append([f"{_plus(a, b, m[k])} AS {a}", f"{_rotate(f'xor({d}, {a})', turn_d)} AS {d}", f"{_plus(c, d)} AS {c}", f"{_rotate(f'xor({b}, {c})', turn_b)} AS {b}"][step])
                    sql = f"SELECT * REPLACE ({', '.join(changed)}) FROM ({sql})"
    gone = ", ".join(f"v{i}" for i in range(16))
    return f"SELECT * EXCLUDE ({gone}) REPLACE ({', '.join(f'xor(xor(h{i}, v{i}), v{i + 8}) AS h{i}' for i in range(8))}) FROM ({sql})"


def tokens(text: str) -> str:
    r"""List of tokens; of the folds beyond lower-casing only that of ß occurs in the test tables."""
    return rf"regexp_extract_all(replace(lower(coalesce({text}, '')), 'ß', 'ss'), '[\p{{L}}\p{{N}}_]+')"


def normalized(text: str) -> str:
    return f"array_to_string({tokens(text)}, ' ')"


def runs(words: str, size: int = 3) -> str:
    """List of distinct word runs of a list of words."""
    return f"CASE WHEN len({words}) = 0 THEN []::VARCHAR[] WHEN len({words}) <= {size} THEN [array_to_string({words}, ' ')] ELSE list_distinct(list_transform(range(1, len({words}) - {size} + 2), lambda i: array_to_string({words}[i:i + {size - 1}], ' '))) END"


def signatures(source: str, seed: int = 1, slots: int = 128, size: int = 3) -> str:
    """CTEs ending in ``sig(id, slot, value)`` for a relation of ``id, t`` (text): the word-run path."""
    coefficients = f"SELECT 'a' AS kind, i, '{seed}:a:' || i AS s FROM range({slots}) r(i) UNION ALL SELECT 'b', i, '{seed}:b:' || i FROM range({slots}) r(i)"
    return f"""shingled AS MATERIALIZED (SELECT id, unnest({runs('w', size)}) AS s FROM (SELECT id, {tokens('t')} AS w FROM {source})),
strings AS MATERIALIZED (SELECT DISTINCT s FROM shingled),
hashed AS MATERIALIZED ({blake2b8('strings')}),
coefficient_names AS MATERIALIZED ({coefficients}),
coefficient_hashes AS MATERIALIZED ({blake2b8('coefficient_names')}),
family AS MATERIALIZED (SELECT x.i, hx.h::HUGEINT % {PRIME - 1} + 1 AS a, hy.h::HUGEINT % {PRIME} AS b FROM coefficient_names x JOIN coefficient_hashes hx USING (s)
  JOIN coefficient_names y ON x.i = y.i AND x.kind = 'a' AND y.kind = 'b' JOIN coefficient_hashes hy ON hy.s = y.s),
permuted AS MATERIALIZED (SELECT s, i, ((a * (h::HUGEINT % {PRIME}) + b) % {PRIME} % 4294967296)::BIGINT AS v FROM hashed, family),
sig AS MATERIALIZED (SELECT x.id, f.i AS slot, coalesce(min(p.v), 0)::BIGINT AS value FROM (SELECT id FROM {source}) x CROSS JOIN family f LEFT JOIN shingled USING (id) LEFT JOIN permuted p ON p.s = shingled.s AND p.i = f.i GROUP BY ALL)"""


def components(vertices: str, edges: str) -> str:
    """Recursive CTE ``component(id, component)`` over ``edges(src, dst)`` and ``vertices(id)``."""
    return f"""both_ways AS MATERIALIZED (SELECT src, dst FROM {edges} UNION SELECT dst, src FROM {edges}),
reach(id, seen) AS (SELECT id, id FROM {vertices} UNION SELECT b.src, r.seen FROM reach r JOIN both_ways b ON b.dst = r.id),
component AS MATERIALIZED (SELECT id, min(seen) AS component FROM reach GROUP BY id)"""


def planes(seed: int = 1, bits: int = 256, dim: int = 64) -> str:
    """Relation of ``plane, p`` (list of doubles)."""
    rows = ", ".join("[" + ", ".join(f"{x!r}" if "e" in repr(float(x)) else f"{float(x)!r}e0" for x in map(float, row)) + "]" for row in hyperplanes(seed, bits, dim))
    return f"(SELECT unnest(range({bits})) AS plane, unnest([{rows}]) AS p)"


def bits(source: str) -> str:
    """CTEs ending in ``bit(id, plane, bit)`` and ``packed(id, hex)`` for ``id, v`` (list of doubles)."""
    return f"""plane AS MATERIALIZED {planes()},
bit AS MATERIALIZED (SELECT id, plane, CASE WHEN isnan(d) THEN 0 WHEN d >= 0 THEN 1 ELSE 0 END AS bit FROM (SELECT id, plane, list_dot_product(v, p) AS d FROM {source}, plane)),
packed AS MATERIALIZED (SELECT id, string_agg(printf('%x', n), '' ORDER BY nibble) AS hex FROM (SELECT id, plane // 4 AS nibble, sum(bit << (3 - plane % 4))::INTEGER AS n FROM bit GROUP BY ALL) GROUP BY id)"""


