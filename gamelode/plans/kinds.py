"""Kinds of events and what each turns into once the front door has let it through."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..config import DEFAULT, Config
from ..operators import economy, monetization, sessions

Handler = Callable[[DataFrame, Config], DataFrame]


def _generic(routed: DataFrame, cfg: Config) -> DataFrame:
    return routed.where("counted AND resolved_kind = 'generic'")


#: kind -> its rows. A kind of one's own is a further entry; the front door takes what is no entry for unknown.
HANDLERS: dict[str, Handler] = {
    "generic": _generic,
    "session": sessions.sessions,
    "economy": economy.flows,
    "purchase": lambda routed, cfg: monetization.purchases(routed),
}


def dispatch(routed: DataFrame, cfg: Config = DEFAULT, handlers: dict[str, Handler] | None = None) -> dict[str, DataFrame]:
    """kind -> rows, for each handler; nothing is read before one of them is."""
    return {kind: handle(routed, cfg) for kind, handle in (HANDLERS if handlers is None else handlers).items()}
