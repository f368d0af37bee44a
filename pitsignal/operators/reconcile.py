"""Linking reversals to the one earlier claim they can mean.

A reversal links only when exactly one claim of its entity (and type, unless its subject
is unclear) was known and still open when the reversal was written.  Enumerating
reversal-claim pairs would be quadratic in the claims of an entity.  Instead each claim
is an arrival and an expiry on a time line; the state of the time line is a count and a
xor of identities, so "exactly one, and which" is read off the state:

1. running sums give each reversal the state of the claims as written; the time line of an entity
   with many claims is cut into blocks of hours and scanned in two levels;
2. links feed back (a superseded claim stops counting, a linked reversal that is not
   negated becomes a claim), so a small fold walks the reversals of an entity in time
   order and keeps only those corrections.  It streams over sorted Arrow batches, holds
   the links still in effect, and skips the reversals that cannot link with numpy;
3. links are joined back to the signals.

Only steps 2 and 3 see reversals one entity at a time, and no step pairs rows up.  A signal is
shuffled once for the scan; to find the ids of linked claims only those signals are shuffled that
a bit set of the links does not rule out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitsignal.functions.clock import to_us
from pitsignal.functions.votes import type_bit
from pitsignal.operators.possible import with_possible
from pitsignal.operators.scan import HOUR_US
from pitsignal.shipping import ship_by_value
from pitsignal.staging import stage
from pitsignal.vocabulary import REASON_NO_SUBJECT, REASON_REVERSAL, REASON_SEPARATOR, SIGNAL_TYPES

# A claim's identity on the time line: two 64-bit hashes, its end (0 = open) and type bit.
_IDENTITY = ("h1", "h2", "end_us", "kind")
_ANY = "*"
WHOLE = 4096  # points of a bucket of entities, up to which the time lines of these are not cut into blocks
BUCKETS = 1 << 16
# What linking reads of a signal, beside the scope.
LINK_COLUMNS = (
    "signal_id", "source_id", "forecast_key", "signal_type", "record_status", "validation_status", "abstention_reason",
    "is_reversal", "negated", "authored_at", "available_at", "effective_end")

ship_by_value(__name__)


def _identity(end_us: str) -> list[str]:
    return [
        "xxhash64(signal_id) as h1", "xxhash64(signal_id, 'second') as h2",
        f"coalesce({end_us}, 0L) as end_us", f"{type_bit()} as kind",
    ]


def gated_reversals(signals: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    """Reversals that may link: resolved entity, and under review for no other reason."""
    allowed = f"array('{REASON_REVERSAL}', '{REASON_NO_SUBJECT}')"
    reasons = f"split(coalesce(abstention_reason, ''), '{REASON_SEPARATOR}')"
    return signals.where(
        f"is_reversal and forecast_key is not null and size(array_except({reasons}, {allowed})) = 0"
    ).selectExpr(
        *scope, "forecast_key", "signal_id", "source_id",
        f"if(signal_type = 'OTHER_RELEVANT', '{_ANY}', signal_type) as kinds",
        f"{to_us('authored_at')} as read_us", f"{to_us('available_at')} as available_us",
        "negated", f"coalesce({to_us('effective_end')}, 0L) as own_end_us",
        "xxhash64(signal_id) as own_h1", "xxhash64(signal_id, 'second') as own_h2",
    )


def open_claims(signals: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    """Claims a reversal could mean; each is on two time lines, that of its type and that of any type."""
    claims = signals.where(
        "record_status = 'ACTIVE' and validation_status = 'PASS' and not negated "
        "and signal_type <> 'NO_SIGNAL' and forecast_key is not null"
    ).selectExpr(
        *scope, "forecast_key", "source_id", "signal_type as kinds",
        f"{to_us('available_at')} as available_us", *_identity(to_us("effective_end")),
    )
    # A claim that had ended before it became known is never open.
    return claims.where("end_us = 0 or end_us > available_us")


def _known_points(signals: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    """Open claims and gated reversals in one narrow layout: ``us`` is when a claim arrives or a reversal was written."""
    entity = (*scope, "forecast_key")
    claims = open_claims(signals, scope).selectExpr(
        *entity, "kinds", "source_id", "available_us as us", *_IDENTITY, "false as reads",
        "cast(null as string) as signal_id", "cast(null as bigint) as available_us", "cast(null as boolean) as negated")
    matched = " and ".join(f"{c} is not null" for c in (*scope, "kinds", "read_us"))
    reversals = gated_reversals(signals, scope).where(matched).selectExpr(
        *entity, "kinds", "source_id", "read_us as us", "own_h1 as h1", "own_h2 as h2", "own_end_us as end_us", "0L as kind",
        "true as reads", "signal_id", "available_us", "negated")
    return claims.union(reversals)


def _large(points: DataFrame, entity: tuple[str, ...]) -> DataFrame:
    """``(bucket)`` of the entities that are cut into blocks of time: all whose bucket holds more than ``WHOLE`` points.

    Buckets, unlike entities, are few, so they are counted map-side and the table is small and stored.
    """
    return stage(points.selectExpr(f"{_bucket(entity)} as bucket").groupBy("bucket").count().where(
        f"count > {WHOLE}").select("bucket"))


def _bucket(entity: tuple[str, ...]) -> str:
    return f"pmod(xxhash64({', '.join(entity)}), {BUCKETS}L)"


def reversal_states(signals: DataFrame, scope: tuple[str, ...] = ("extraction_run_id",)) -> DataFrame:
    """Each gated reversal with the state of the claims as written when it was authored.

    Columns ``n`` and the xor of the identities; with ``n = 1`` they are the identity of
    the only candidate.  Links between reversals are not considered yet.

    A claim or reversal is shuffled once, by entity and block; what it does to which time line, and
    when, is spelled out after that.  At an instant come expiries, then arrivals and the reversals of
    notes that became available at the very moment they were written, by source, then the reversals
    of the others.
    """
    entity = (*scope, "forecast_key")
    line = (*entity, "kinds")
    points = _known_points(signals, scope)
    large = _large(points, entity)
    cut = not large.isEmpty()
    at = lambda us: f"if(cut, coalesce({us} div {HOUR_US}L, {-1 << 62}L), 0L)"
    if cut:
        marked = points.selectExpr("*", f"{_bucket(entity)} as bucket").join(
            large.selectExpr("bucket", "true as large"), "bucket", "left").selectExpr(
            *points.columns, "coalesce(large, false) as cut")
        dealt = marked.selectExpr("*", f"explode(array_distinct(if(reads or end_us <= 0, array({at('us')}), "
                                  f"array({at('us')}, {at('end_us')})))) as block")
    else:
        dealt = points.selectExpr("*", "false as cut", "0L as block")

    def spelled_out(rows: DataFrame) -> DataFrame:
        when = "case when us < available_us then 3 when us = available_us then 2 else 1 end"
        rest = [c for c in rows.columns if c != "kinds"]
        return rows.selectExpr(
            *rest, f"explode(if(reads, array(kinds), array(kinds, '{_ANY}'))) as kinds",
        ).selectExpr(
            "*", f"explode(if(reads, array({when}), if(end_us > 0, array(2, 0), array(2)))) as phase",
        ).selectExpr(
            "*", "if(phase = 0, end_us, us) as at_us", "case when reads then 0L when phase = 0 then -1L else 1L end as step",
        ).where(f"block = {at('at_us')}")

    measures = [("n", "sum(step)"), *((c, f"bit_xor(if(reads, 0L, {c}))") for c in _IDENTITY)]
    so_far = (f"(partition by {', '.join(line)}, block order by at_us, phase, source_id, if(reads, 0, 1) "
              "rows between unbounded preceding and current row)")
    own = ("signal_id", "source_id", "us as read_us", "available_us", "negated", "end_us as own_end_us", "h1 as own_h1", "h2 as own_h2")
    read = spelled_out(dealt.repartition(*entity, "block")).selectExpr(
        *line, "block", "reads", *own, *(f"{how} over {so_far} as in_{c}" for c, how in measures)).where("reads")
    if not cut:
        return read.selectExpr(*line, *(c.split()[-1] for c in own), *(f"in_{c} as {c}" for c, _ in measures))
    # A large entity has the state before a block from one row for each of its blocks.
    totals = spelled_out(dealt.where("cut")).groupBy(*line, "block").agg(*(F.expr(f"{how} as {c}") for c, how in measures))
    before = f"(partition by {', '.join(line)} order by block rows between unbounded preceding and 1 preceding)"
    offsets = totals.selectExpr(
        *line, "block", f"sum(n) over {before} as off_n", *(f"bit_xor({c}) over {before} as off_{c}" for c in _IDENTITY))
    return read.join(offsets, [*line, "block"], "left").selectExpr(
        *line, *(c.split()[-1] for c in own), "in_n + coalesce(off_n, 0L) as n",
        *(f"in_{c} ^ coalesce(off_{c}, 0L) as {c}" for c in _IDENTITY))


_LINK_SCHEMA = "signal_id string, target_h1 bigint, target_h2 bigint, target_kind bigint"


class _Corrections:
    """What earlier links of one entity changed about the time lines."""

    def __init__(self) -> None:
        self.agenda: list[tuple] = []  # (position, order, action, claim), a heap
        self.order = 0
        self.delta: dict[str, list[int]] = {}
        self.waiting: dict[tuple, int] = {}  # links to a claim that are not in effect yet
        self.closed: set[tuple] = set()  # of those, the claims already superseded

    def at(self, kinds: str) -> list[int]:
        return self.delta.setdefault(kinds, [0, 0, 0, 0, 0])

    def plan(self, position: tuple, action: str, claim: tuple) -> None:
        self.order += 1
        heapq.heappush(self.agenda, (position, self.order, action, claim))

    def _change(self, claim: tuple, n: int) -> None:
        for kinds in (SIGNAL_TYPES[claim[3].bit_length() - 1], _ANY):
            d = self.at(kinds)
            d[0] += n
            for i, part in enumerate(claim, start=1):
                d[i] ^= part

    def link(self, claim: tuple, available_us: int, source_id: str) -> None:
        self.waiting[claim] = self.waiting.get(claim, 0) + 1
        self.plan((available_us, 0, source_id), "supersede", claim)

    def advance(self, position: tuple) -> None:
        """Apply everything that happened before ``position``."""
        while self.agenda and self.agenda[0][0] < position:
            (us, _, _), _, action, claim = heapq.heappop(self.agenda)
            end = claim[2]
            if action == "supersede":
                self.waiting[claim] -= 1
                if claim not in self.closed and (end == 0 or end > us):
                    self._change(claim, -1)
                    self.closed.add(claim)
                    if end:
                        self.plan((end, -1, ""), "restore", claim)
                if not self.waiting[claim]:
                    del self.waiting[claim]
                    self.closed.discard(claim)
            elif action == "arrive":
                self._change(claim, 1)
                if end:
                    self.plan((end, -1, ""), "expire", claim)
            else:  # "restore" a superseded claim that the scan drops itself, or "expire" an added one
                self._change(claim, 1 if action == "restore" else -1)


def _fold(batches: Iterator[pd.DataFrame], group: list[str]) -> Iterator[pd.DataFrame]:
    """Decide links over reversals sorted by entity and reading position."""
    current, state = None, _Corrections()
    for batch in batches:
        if not len(batch):
            continue
        keys = [batch[c].to_numpy() for c in group]
        columns = {c: batch[c].to_numpy() for c in (
            "signal_id", "source_id", "kinds", "read_us", "available_us", "negated", "n", *_IDENTITY,
            "own_end_us", "own_h1", "own_h2")}
        changed = np.zeros(len(batch), bool)
        changed[0] = True
        for k in keys:
            changed[1:] |= k[1:] != k[:-1]
        starts = np.flatnonzero(changed)
        stops = np.append(starts[1:], len(batch))
        # Without a lone candidate as written there is no first link, hence no correction.
        lone = np.logical_or.reduceat(columns["n"] == 1, starts)
        links: list[tuple] = []
        for start, stop, some in zip(starts.tolist(), stops.tolist(), lone.tolist()):
            key = tuple(k[start] for k in keys)
            if key != current:
                current, state = key, _Corrections()
            if some or state.delta or state.agenda:
                links.extend(_fold_entity({c: v[start:stop] for c, v in columns.items()}, state))
        if links:
            yield pd.DataFrame(links, columns=["signal_id", "target_h1", "target_h2", "target_kind"])


def _fold_entity(rows: dict[str, np.ndarray], state: _Corrections) -> Iterator[tuple]:
    read, avail, n, kinds = rows["read_us"], rows["available_us"], rows["n"], rows["kinds"]
    masks = {k: kinds == k for k in set(kinds.tolist())}
    i, size = 0, len(read)
    while i < size:
        late = read[i] < avail[i]
        state.advance((int(read[i]), 1, "") if late else (int(read[i]), 0, rows["source_id"][i]))
        # Rows read before the next correction all see the present one.
        stop = size
        if state.agenda:
            stop = max(i + 1, int(read.searchsorted(state.agenda[0][0][0], side="left")))
        lone = np.zeros(stop - i, bool)
        for k, mask in masks.items():
            lone |= mask[i:stop] & (n[i:stop] + state.at(k)[0] == 1)
        hits = lone.nonzero()[0]
        if not len(hits):
            i = stop
            continue
        j = i + int(hits[0])
        delta = state.at(kinds[j])
        claim = tuple(int(rows[c][j]) ^ delta[p] for p, c in enumerate(_IDENTITY, start=1))
        state.link(claim, int(avail[j]), rows["source_id"][j])
        own_end = int(rows["own_end_us"][j])
        if not rows["negated"][j] and (own_end == 0 or own_end > avail[j]):
            own = (int(rows["own_h1"][j]), int(rows["own_h2"][j]), own_end, claim[3])
            state.plan((int(avail[j]), 0, rows["source_id"][j]), "arrive", own)
        yield rows["signal_id"][j], claim[0], claim[1], claim[3]
        i = j + 1


def reversal_links(signals: DataFrame, scope: tuple[str, ...] = ("extraction_run_id",)) -> DataFrame:
    """``(signal_id, target_signal_id, target_type)`` for every reversal that links."""
    group = [*scope, "forecast_key"]
    ordered = (
        reversal_states(signals, scope)
        .selectExpr("*", "read_us < available_us as late")
        .repartition(*group)
        .sortWithinPartitions(*group, "read_us", "late", "source_id")
    )
    links = stage(ordered.mapInPandas(lambda batches: _fold(batches, group), _LINK_SCHEMA))
    targets = with_possible(
        signals.where("validation_status = 'PASS' or is_reversal").select("signal_id"), links,
        key="target_h1", hashed="xxhash64(signal_id)",
    ).where("possible").selectExpr(
        "xxhash64(signal_id) as target_h1", "xxhash64(signal_id, 'second') as target_h2",
        "signal_id as target_signal_id")
    name = " ".join(f"when {1 << i}L then '{t}'" for i, t in enumerate(SIGNAL_TYPES))
    return links.join(targets, ["target_h1", "target_h2"]).selectExpr(
        "signal_id", "target_signal_id", f"case target_kind {name} end as target_type")


def relinked_reversals(signals: DataFrame, scope: tuple[str, ...] = ("extraction_run_id",)) -> DataFrame:
    """The reversals of ``signals`` with the links applied: a linked one passes and takes over the claim's type."""
    links = reversal_links(signals, scope)
    linked = "target_signal_id is not null"
    channel = "if(target_type = 'SUPPLY_FULFILLMENT', 'FULFILLMENT', if(target_type = 'OTHER_RELEVANT', 'UNKNOWN', 'DEMAND'))"
    changed = {
        "signal_type": "target_type", "signal_subtype": "'cancelled'", "impact_channel": channel,
        "supersedes_signal_id": "target_signal_id", "related_signal_ids": "array(target_signal_id)",
        "validation_status": "'PASS'", "abstention_reason": "cast(null as string)",
    }
    return signals.where("is_reversal").join(links, "signal_id", "left").selectExpr(
        *(f"if({linked}, {changed[c]}, {c}) as {c}" if c in changed else c for c in signals.columns))


def not_reversals(signals: DataFrame) -> DataFrame:
    return signals.where("not coalesce(is_reversal, false)")


def reconcile(signals: DataFrame, scope: tuple[str, ...] = ("extraction_run_id",)) -> DataFrame:
    """All signals, the reversals among them linked; only these are shuffled to meet their links."""
    return relinked_reversals(signals, scope).union(not_reversals(signals))
