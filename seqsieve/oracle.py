"""The operators as plain SQL (DuckDB dialect), from their definitions: one row a base, window functions, joins."""

from __future__ import annotations

from .functions.sequence import BASES, LETTERS
from .params import FilterParams

# fixed values of the published scheme, stated here again so that a wrong one shows
CODE = {"A": 0x95C60474, "C": 0x62A02B4C, "T": 0x82572324, "G": 0x4BE24456}
PAIR = dict(zip("ACGT", "TGCA"))
M32 = 0xFFFFFFFF


def dna(text: str, ambiguous: bool = False) -> str:
    bases = BASES[:-1] + "N" if ambiguous else BASES
    return f"translate(regexp_replace({text}, '[^A-Za-z]', '', 'g'), 'ACGTacgt{LETTERS[:-1]}{LETTERS[:-1].lower()}Nn', 'ACGTACGT{bases}{bases}')"


def _rotl(x: str, n: str) -> str:
    return f"(((({x})::BIGINT << (({n}) % 32)::INT) | (({x})::BIGINT >> (32 - ({n}) % 32)::INT)) & {M32})"


def _rotr(x: str, n: str) -> str:
    return _rotl(x, f"(32 - ({n}) % 32)")


def revcomp(s: str) -> str:
    return f"translate(reverse({s}), 'ACGT', 'TGCA')"


def minimizers(name: str, source: str, k: int, w: int) -> str:
    """CTEs ending in `name` (id, pos, kmer) over `source` (id, seq)."""
    span = k + w - 1
    case = lambda t: "CASE c " + " ".join(f"WHEN '{b}' THEN {t[b]}" for b in "ACGT") + " ELSE 0 END"
    over = "PARTITION BY id ORDER BY pos"
    return f"""{name}_1 AS (SELECT id, pos, substr(seq, pos + 1, 1) AS c FROM (SELECT id, seq, unnest(range(length(seq))) AS pos FROM {source} WHERE length(seq) >= {span})),
{name}_2 AS (SELECT *, bit_xor({_rotr(case(CODE), 'pos')}) OVER (w ROWS UNBOUNDED PRECEDING) AS pf, bit_xor({_rotl(case({b: CODE[PAIR[b]] for b in PAIR}), 'pos')}) OVER (w ROWS UNBOUNDED PRECEDING) AS pr FROM {name}_1 WINDOW w AS ({over})),
{name}_3 AS (SELECT id, pos, xor(lead(pf, {k - 1}) OVER w, coalesce(lag(pf) OVER w, 0)) AS xf, xor(lead(pr, {k - 1}) OVER w, coalesce(lag(pr) OVER w, 0)) AS xr,
  sum((c NOT IN ('A', 'C', 'G', 'T'))::INT) OVER f AS amb, sum((c IN ('G', 'T'))::INT) OVER f AS gt, count(*) OVER f AS n
  FROM {name}_2 WINDOW w AS ({over}), f AS ({over} ROWS BETWEEN CURRENT ROW AND {span - 1} FOLLOWING)),
{name}_4 AS (SELECT *, ({_rotl('xf', f'pos + {k - 1}')} + {_rotr('xr', 'pos')}) & {M32} AS h FROM {name}_3),
{name}_5 AS (SELECT *, min(h * 1048576 + pos) OVER f AS lo, min(h * 1048576 + 1048575 - pos) OVER f AS hi FROM {name}_4 WINDOW f AS ({over} ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING)),
{name}_6 AS (SELECT id, pos AS p0, CASE WHEN 2 * gt > {span} THEN lo % 1048576 ELSE 1048575 - hi % 1048576 END AS pos FROM {name}_5 WHERE n = {span} AND amb = 0),
{name}_7 AS (SELECT *, lag(pos) OVER (PARTITION BY id ORDER BY p0) AS prev FROM {name}_6),
{name} AS (SELECT id, pos::INT AS pos, least(substr(seq, pos + 1, {k}), {revcomp(f'substr(seq, pos + 1, {k})')}) AS kmer FROM {name}_7 JOIN {source} USING (id) WHERE prev IS NULL OR prev <> pos)"""


def index(name: str, table: str, text: str, k: int, w: int) -> str:
    """CTEs ending in `name` (kmer), the distinct minimizers of a table's text."""
    return f"""{name}_s AS (SELECT row_number() OVER () AS id, {dna(text)} AS seq FROM {table}),
{minimizers(name + '_m', name + '_s', k, w)},
{name} AS (SELECT DISTINCT kmer FROM {name}_m)"""


def keep(p: FilterParams, hits: str = "hit_count", total: str = "total_minimizers") -> str:
    return f"CASE WHEN {total} = 0 THEN {str(p.deplete).upper()} ELSE ({hits} >= greatest({p.abs_threshold}, greatest(1, round({p.rel_threshold}::DOUBLE * {total})))) <> {str(p.deplete).upper()} END"


def reads(ambiguous: bool = False, prefix: int = 0) -> str:
    seq = dna("text", ambiguous)
    return f"reads AS (SELECT doc_id AS id, {seq} AS full_seq, {f'substr({seq}, 1, {prefix})' if prefix else seq} AS seq FROM documents)"


def decisions(p: FilterParams, k: int = 31, w: int = 15, ambiguous: bool = False, index_ctes: str | None = None) -> str:
    """CTEs ending in `dec` (id, full_seq, total_minimizers, hit_count, keep)."""
    return f"""{reads(ambiguous, p.prefix_length)},
{minimizers('rm', 'reads', k, w)},
{index_ctes or index('ix', 'benchmark', 'text', k, w)},
cnt AS (SELECT id, count(*) AS total_minimizers, count(DISTINCT ix.kmer) AS hit_count FROM rm LEFT JOIN ix USING (kmer) GROUP BY id),
dec0 AS (SELECT reads.id, full_seq, coalesce(total_minimizers, 0) AS total_minimizers, coalesce(hit_count, 0) AS hit_count FROM reads LEFT JOIN cnt USING (id)),
dec AS (SELECT *, {keep(p)} AS keep FROM dec0)"""


def kdust(k: int, relation: str) -> str:
    """Query of (kmer, value FLOAT)."""
    return f"SELECT kmer, (1 - sum(n * (n - 1) / 2) / ({k - 2} * {k - 3} / 2.0))::FLOAT AS value FROM (SELECT kmer, t, count(*) AS n FROM (SELECT kmer, substr(kmer, i, 3) AS t FROM {relation}, unnest(range(1, {k - 1})) u(i)) GROUP BY kmer, t) GROUP BY kmer"


def shannon(k: int, relation: str) -> str:
    count = lambda b: f"({k} - length(replace(kmer, '{b}', '')))"
    part = lambda b: f"CASE WHEN {count(b)} = 0 THEN 0 ELSE {count(b)} / {k}::DOUBLE * log2({count(b)} / {k}::DOUBLE) END"
    return f"SELECT kmer, (abs({' + '.join(part(b) for b in 'ACGT')}) / 2)::FLOAT AS value FROM {relation}"
