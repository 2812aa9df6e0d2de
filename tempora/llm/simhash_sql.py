"""Operator 6 in SQL for the oracle: XXH64 spelled out in 128-bit arithmetic, fingerprints, all pairs of fingerprints, and components."""

from __future__ import annotations

# Fixed values, given by the hash's definition.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
_M = 1 << 64


def _n(x: int) -> str:
    return f"{x}::uhugeint"


def _add(a: str, b: str) -> str:
    return f"(({a} + {b}) & {_n(_M - 1)})"


def _mul(a: str, p: int) -> str:
    return f"({a} * {_n(p)} & {_n(_M - 1)})"


def _turn(x: str, r: int) -> str:
    return f"(({x} & {_n((1 << (64 - r)) - 1)}) * {_n(1 << r)} + ({x} >> {64 - r}))"


def _xor(a: str, b: str) -> str:
    return f"xor({a}::ubigint, {b}::ubigint)::uhugeint"


def _round(a: str, lane: str) -> str:
    return _mul(_turn(_add(a, _mul(lane, P2)), 31), P1)


def _lane(at: str, size: int) -> str:
    """size bytes from a place on, little-endian; r holds the hex digits of the bytes in reverse order."""
    return f"('0x' || substr(r, 2 * (n - ({at}) - {size}) + 1, {2 * size}))::ubigint::uhugeint"


def oracle(shingle: int, radius: int, seed: int) -> str:
    start = (seed + P1 + P2, seed + P2, seed, seed - P1)
    v = [f"case when n >= 32 then list_reduce(list_prepend({_n(x % _M)}, list_transform(range(n // 32), lambda j: {_lane(f'j * 32 + {8 * k}', 8)})), lambda a, l: {_round('a', 'l')}) end" for k, x in enumerate(start)]
    joined = _add(_add(_add(_turn("v1", 1), _turn("v2", 7)), _turn("v3", 12)), _turn("v4", 18))
    merge = lambda h, x: _add(_mul(_xor(h, _round(_n(0), x)), P1), _n(P4))
    tail = [f"case when n % 32 >= {8 * k + 8} then {_add(_mul(_turn(_xor('h', _round(_n(0), _lane(f'n // 32 * 32 + {8 * k}', 8))), 27), P1), _n(P4))} else h end" for k in range(3)]
    four = f"case when n % 8 >= 4 then {_add(_mul(_turn(_xor('h', _mul(_lane('n // 8 * 8', 4), P1)), 23), P2), _n(P3))} else h end"
    ones = [f"case when n % 4 > {k} then {_mul(_turn(_xor('h', _mul(_lane(f'n // 4 * 4 + {k}', 1), P5)), 11), P1)} else h end" for k in range(3)]
    steps = ["case when n < 32 then " + _n((seed + P5) % _M) + f" else {joined} end", *(f"case when n < 32 then h else {merge('h', x)} end" for x in ("v1", "v2", "v3", "v4")), _add("h", "n::uhugeint"), *tail, four, *ones]
    steps += [_mul(_xor("h", "(h >> 33)"), P2), _mul(_xor("h", "(h >> 29)"), P3), _xor("h", "(h >> 32)")]
    ctes = [f"h{i} as (select doc_id, n, r, v1, v2, v3, v4, {x} as h from {'v' if not i else f'h{i - 1}'})" for i, x in enumerate(steps)]
    bits = " + ".join(f"case when 2 * sum((g >> {b}) & 1) > count(*) then {1 << b}::uhugeint else 0::uhugeint end" for b in range(64))
    return f"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select doc_id, encode(array_to_string(w[i:i + {shingle - 1}], ' ')) as s from (select doc_id, w, unnest(range(1, greatest(len(w) - {shingle - 1}, 1) + 1)) as i from d where len(w) > 0) t),
x as (select doc_id, octet_length(s)::bigint as n, reverse(regexp_replace(hex(s), '(.)(.)', '\\2\\1', 'g')) as r from s),
v as (select doc_id, n, r, {', '.join(f'{y} as v{k + 1}' for k, y in enumerate(v))} from x),
{', '.join(ctes)},
e as (select doc_id, ({bits})::ubigint as fp from (select doc_id, h::ubigint as g from h{len(steps) - 1}) t group by doc_id),
each as (select d.doc_id, coalesce(e.fp, 0::ubigint) as fp from d left join e on e.doc_id = d.doc_id),
f as (select fp, min(doc_id) as least from each group by fp),
link as (select a.fp as i, b.fp as j from f a join f b on a.fp <> b.fp and bit_count((xor(a.fp, b.fp) >> 32)::bigint) + bit_count((xor(a.fp, b.fp) & 4294967295::ubigint)::bigint) <= {radius}),
reach as (select fp as i, least as c from f union select link.j, reach.c from reach join link on link.i = reach.i),
known as (select i, min(c) as component_id from reach group by i)
select doc_id, lower(lpad(to_hex(fp), 16, '0')) as fingerprint, component_id from each join known on known.i = each.fp
"""
