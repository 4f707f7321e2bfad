"""The streaming twin of the fact history: claims in, outcomes out.

State is kept per (user_id, slot): the current value and trust.  Claims are applied as
they arrive, in order of ``seq`` within a micro-batch; a late one is applied late, as a
store does that cannot take back what it has answered.  A ``seq`` that was seen before
is skipped, so replays change nothing; blocked events never come in.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "seq bigint, user_id bigint, slot string, outcome string"
STATE = "value string, trust int"


def step(value: str | None, trust: int, claim, introduce_trust: int) -> tuple[str, str | None, int]:
    """(outcome, value, trust) after one claim."""
    if claim.is_delete:
        return "delete", None, 0
    if value is None:
        if claim.trust >= introduce_trust:
            return "introduce", claim.value, claim.trust
        return "hold", None, 0
    if claim.value == value:
        return "restate", value, max(trust, claim.trust)
    if claim.trust < trust:
        return "dispute", value, trust
    return "supersede", claim.value, claim.trust


def stream_outcomes(claims: DataFrame, introduce_trust: int = 2, blocked: DataFrame | None = None) -> DataFrame:
    """Outcomes of a streaming claim table (columns as in ``operators.facts``); blocked:
    a static table (user_id, seq)."""

    def apply(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, trust = state.get if state.exists else (None, 0)
        out = []
        for claim in pd.concat(list(frames)).sort_values("seq").itertuples(index=False):
            outcome, value, trust = step(value, trust, claim, introduce_trust)
            out.append((claim.seq, key[0], key[1], outcome))
        state.update((value, int(trust)))
        yield pd.DataFrame(out, columns=["seq", "user_id", "slot", "outcome"])

    if blocked is not None:
        claims = claims.join(blocked.select("user_id", "seq"), ["user_id", "seq"], "left_anti")
    claims = claims.dropDuplicates(["seq"])
    return claims.groupBy("user_id", "slot").applyInPandasWithState(apply, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
