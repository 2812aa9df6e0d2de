"""Operator 5: secret scan with corpus-wide ownership frequency.

A first pass finds candidates in every whole text: the three base kinds (assign, access, hex) and two that the method
adds: provider tokens of known shape and private keys with their bodies, and generic strings of high entropy. A
provider span inside a base span is dropped, as is a generic one that overlaps any other. Each candidate's value (of a
private key, its body without white space) is hashed; hashes are aggregated by distinct repositories (source) and owners
(what precedes its first slash). A value that at least COMMON owners have is a widely copied example; others are
live-looking. Base and provider spans are reported in either case; a generic span only if it is live-looking.

Null text is empty, null source an owner of its own name. Repeated rows give repeated results; an empty table
gives no rows; extra columns are ignored. A scan shuffles hashes, spans and counts only, never texts or values;
redaction moves the texts of documents with generic candidates and no others.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import materialize

KINDS = ("assign", "access", "hex", "provider", "generic")
COMMON, ENTROPY = 3, 3.8
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # the same as matches of AKIA[A-Z0-9]+ with 18 or more characters
_HEX = re.compile(r"[0-9a-f]{16,}")
_KEY = re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----((?:[ \t\r\n]*(?:Proc-Type|DEK-Info): [^\n]*)*)(?:([A-Za-z0-9+/= \t\r\n\\]*)-----END [A-Z ]{0,30}PRIVATE KEY-----|((?:[ \t\r\n]*[A-Za-z0-9+/=]{16,})*))")
_PROVIDER = re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{20,}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")
_GENERIC = re.compile(r"[A-Za-z0-9+/_=-]{24,}")
_FOUND = "array<struct<kind:int,start:int,end:int,hash:long>>"


def entropy(s: str) -> float:
    """Bits a character."""
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) of the base kinds, by start, then kind."""
    out = [(0, *m.span(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(1, *m.span(), m[0]) for m in _ACCESS.finditer(text)]
    out += [(2, *m.span(), m[0]) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], x[0]))


class Spans:
    """Whether a span lies in, or overlaps, one of many: by binary search, whatever their number."""

    def __init__(self, spans: list[tuple]):
        each = sorted((x[1], x[2]) for x in spans)
        self.starts, self.ends = [x[0] for x in each], list(itertools.accumulate((x[1] for x in each), max))

    def hold(self, start: int, end: int) -> bool:
        k = bisect.bisect_right(self.starts, start)
        return k > 0 and self.ends[k - 1] >= end

    def touch(self, start: int, end: int) -> bool:
        k = bisect.bisect_left(self.starts, end)
        return k > 0 and self.ends[k - 1] > start


def added_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) of the added kinds."""
    known = Spans(base)
    more = [(3, *m.span(), m[0]) for m in _PROVIDER.finditer(text) if not known.hold(*m.span())]
    if "PRIVATE KEY-----" in text:
        more += [(3, *m.span(), re.sub(r"\\[nr]|\s", "", m[2] or m[3] or "") or m[0]) for m in _KEY.finditer(text)]
    if more:
        known = Spans(base + more)
    for m in _GENERIC.finditer(text):
        s = m[0]
        if re.search("[0-9]", s) and re.search("[a-z]", s) and re.search("[A-Z]", s) and entropy(s) >= ENTROPY and not known.touch(*m.span()):
            more.append((4, *m.span(), s))
    return more


def told(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[k]}:{i}:{j}" for k, i, j, *_ in spans)


def hashed(value: str) -> int:
    return int.from_bytes(hashlib.sha256(value.encode()).digest()[:8], "big", signed=True)


def _source() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")


def candidates(docs: DataFrame) -> DataFrame:
    """row (unique), doc_id, source, base figures and found: all candidates of each document, without its text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf.pop("text").tolist():
                base = base_spans(text)
                n = Counter(x[0] for x in base)
                found = [{"kind": k, "start": i, "end": j, "hash": hashed(v)} for k, i, j, v in base + added_spans(text, base)]
                rows.append((n[0], n[1], n[2], hashlib.sha256(told(base).encode()).hexdigest(), found))
            yield pd.concat([pdf, pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "found"])], axis=1)

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _source(), text)
    got = rows.mapInPandas(run, f"doc_id long, source string, n_assign long, n_access long, n_hex long, base_sha256 string, found {_FOUND}")
    return materialize(got.withColumn("row", F.monotonically_increasing_id()), "candidates")


def ownership(found: DataFrame, hashes: str = "found.hash") -> DataFrame:
    """hash, n_repositories, n_owners, over the whole corpus; each step has partial aggregation."""
    each = found.select(F.explode(hashes).alias("hash"), "source", F.substring_index("source", "/", 1).alias("owner")).distinct()
    return each.groupBy("hash").agg(F.count_distinct("source").alias("n_repositories"), F.count_distinct("owner").alias("n_owners"))


def _judged(found: DataFrame, common: int) -> DataFrame:
    """row, spans (structs in order), n_live, n_example, n_reported."""
    owners = materialize(ownership(found), "ownership")
    each = found.select("row", F.explode("found").alias("x")).select("row", "x.*")
    each = each.join(owners, "hash").withColumn("live", F.col("n_owners") < common)
    each = each.where((F.col("kind") < 4) | F.col("live"))
    return each.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("all"), F.sum(F.col("live").cast("long")).alias("n_live"), F.sum((~F.col("live")).cast("long")).alias("n_example"))


def scan(docs: DataFrame, common: int = COMMON) -> DataFrame:
    found = candidates(docs)
    names = F.array(*map(F.lit, KINDS))
    spans = F.array_join(F.transform("all", lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")
    out = found.drop("found").join(_judged(found, common), "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce(spans, F.lit("")).alias("spans"), zero("n_live"), zero("n_example"))


def masked(text: str, spans: list[tuple[int, int]], mark: str) -> tuple[str, list[int], list[int]]:
    """text with mark for each run of overlapping spans; ends of these runs in text, and what is to be added to a position from there on."""
    out, ends, moved, done, size = [], [], [], 0, 0
    for start, end in sorted(spans):
        if not ends or start >= ends[-1]:
            out += [text[done:start], mark]
            size += start - done + len(mark)
            ends.append(end)
            moved.append(size - end)
        elif end > ends[-1]:
            moved[-1] -= end - ends[-1]
            ends[-1] = end
        done = ends[-1]
    return "".join([*out, text[done:]]), ends, moved


def redact(docs: DataFrame, common: int = COMMON, mark: str = "[SECRET]") -> DataFrame:
    """docs with every reported span replaced by mark and n_chars brought up to date; texts without spans stay as they are.

    Base and provider spans, reported in any case, are masked where the text lies. Only documents with generic candidates
    wait for what the corpus says of these."""
    names, kind = docs.columns, dict(docs.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, pending, hashes = pdf["text"].astype(object).tolist(), [], []
            for k, text in enumerate(texts):
                text = text if isinstance(text, str) else ""
                base = base_spans(text)
                more = added_spans(text, base)
                sure, wait = [x for x in base + more if x[0] < 4], [x for x in more if x[0] == 4]
                hashes.append(sorted({hashed(x[3]) for x in base + more}))
                if sure:
                    texts[k], ends, moved = masked(text, [x[1:3] for x in sure], mark)
                to = [moved[i - 1] if sure and (i := bisect.bisect_right(ends, x[1])) else 0 for x in wait]
                pending.append([{"start": x[1] + d, "end": x[2] + d, "hash": hashed(x[3])} for x, d in zip(wait, to, strict=True)])
            yield pdf.assign(text=texts, pending_=pending, hashes_=hashes)

    fields = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    rows = materialize(docs.mapInPandas(run, f"{fields}, pending_ array<struct<start:int,end:int,hash:long>>, hashes_ array<long>").withColumn("row_", F.monotonically_increasing_id()), "masked")
    source = _source() if "source" in names else F.lit("").alias("source")
    owners = materialize(ownership(rows.select(source, F.col("hashes_").alias("hashes")), "hashes").where(F.col("n_owners") < common), "live")
    each = rows.select("row_", F.explode("pending_").alias("x_")).select("row_", "x_.*").join(owners, "hash", "left_semi")
    live = each.groupBy(F.col("row_").alias("of_")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("live_"))

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            live = pdf.pop("live_").tolist()
            yield pdf.assign(text=[t if x is None else masked(t, [(s["start"], s["end"]) for s in x], mark)[0] for t, x in zip(pdf["text"].astype(object).tolist(), live, strict=True)])

    waiting = rows.where(F.size("pending_") > 0)
    done = waiting.join(live, F.col("row_") == F.col("of_"), "left").select(*names, "live_").mapInPandas(finish, fields)
    out = rows.where(F.size("pending_") == 0).select(*names).union(done)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(kind["n_chars"])).otherwise(F.col("n_chars"))) if "n_chars" in names else out


def _sql() -> str:
    q = lambda x: x.replace("'", "''")
    word = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    kinds = (f"""(?:{word})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""", _ACCESS.pattern, _HEX.pattern, _PROVIDER.pattern, _KEY.pattern, _GENERIC.pattern)
    one = " union all ".join(f"select doc_id, source, {k} as r, string_split(regexp_replace(t, '{q(p)}', chr(57344) || '\\0' || chr(57345), 'g'), chr(57344)) as parts from d" for k, p in enumerate(kinds))
    return f"""
with d as (select doc_id, coalesce(source, '') as source, coalesce(text, '') as t from documents),
p as (select doc_id, source, r, unnest(parts) as part, generate_subscripts(parts, 1) as i from ({one}) x where len(parts) > 1),
m as (select doc_id, source, r, i, string_split(part, chr(57345))[1] as m, cast(sum(length(part)) over (partition by doc_id, r order by i rows unbounded preceding) - length(part) - greatest(i - 2, 0) as int) as s from p),
f as (select doc_id, source, r, m, s, s + length(m) as e, case r when 0 then regexp_extract(m, '{q(kinds[0])}', 1)
      when 4 then coalesce(nullif(regexp_replace(regexp_extract(m, '{q(kinds[4])}', 2) || regexp_extract(m, '{q(kinds[4])}', 3), '\\\\[nr]|[ \\t\\r\\n]', '', 'g'), ''), m) else m end as v from m where i > 1),
base as (select * from f where r in (1, 2) or (r = 0 and length(v) >= 12)),
given as (select * from base union all select * from f where r = 4 or (r = 3 and not exists (select 1 from base b where b.doc_id = f.doc_id and b.s <= f.s and b.e >= f.e))),
every as (select doc_id, source, least(r, 3) as kind, s, e, v from given union all
  select doc_id, source, 4, s, e, v from f where r = 5 and regexp_matches(v, '[0-9]') and regexp_matches(v, '[a-z]') and regexp_matches(v, '[A-Z]') and list_aggregate(string_split(v, ''), 'entropy') >= {ENTROPY}
   and not exists (select 1 from given b where b.doc_id = f.doc_id and b.s < f.e and f.s < b.e)),
own as (select v, count(distinct split_part(source, '/', 1)) as owners from every group by v),
told as (select doc_id, kind, s, e, owners < {COMMON} as live, ['assign', 'access', 'hex', 'provider', 'generic'][kind + 1] || ':' || s || ':' || e as x from every join own using (v) where kind < 4 or owners < {COMMON}),
g as (select doc_id, count(*) filter (where kind = 0) as n0, count(*) filter (where kind = 1) as n1, count(*) filter (where kind = 2) as n2, string_agg(x, ',' order by s, kind) filter (where kind < 3) as b,
  string_agg(x, ',' order by s, kind, e) as a, count(*) filter (where live) as n_live, count(*) filter (where not live) as n_example from told group by doc_id)
select d.doc_id, coalesce(n0, 0) as n_assign, coalesce(n1, 0) as n_access, coalesce(n2, 0) as n_hex, sha256(coalesce(b, '')) as base_sha256, coalesce(a, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_example, 0) as n_example
from d left join g on g.doc_id = d.doc_id
"""


ORACLE = _sql()
