"""Time rules as column expressions: skew correction, logical days, seals, session intervals."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..config import DAY_MS, DEFAULT, Config


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def logical_day(ms, cfg: Config = DEFAULT) -> Column:
    """Date of an instant after a rigid shift by the reporting offset; floors for times before the epoch."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor((_col(ms) + cfg.reporting_offset_min * 60_000) / DAY_MS).cast("int"))


def day_start_ms(day, cfg: Config = DEFAULT) -> Column:
    return F.unix_date(_col(day)).cast("long") * DAY_MS - cfg.reporting_offset_min * 60_000


def fallback(event, sent, recv, cfg: Config = DEFAULT) -> Column:
    return F.abs(_shifted(event, sent, recv, cfg) - _col(recv)) > cfg.fallback_after_ms


def _shifted(event, sent, recv, cfg: Config) -> Column:
    skew = _col(recv) - _col(sent)
    return F.least(F.when(F.abs(skew) > cfg.skew_dead_band_ms, _col(event) + skew).otherwise(_col(event)), _col(recv))


def corrected(event, sent, recv, cfg: Config = DEFAULT) -> Column:
    """Event time on the server's clock: shifted by a skew over the dead band, never after receipt, and receipt itself
    where the two are too far apart."""
    return F.when(fallback(event, sent, recv, cfg), _col(recv)).otherwise(_shifted(event, sent, recv, cfg))


def seal_state(day, now, cfg: Config = DEFAULT) -> Column:
    end = day_start_ms(day, cfg) + DAY_MS
    return F.when(_col(now) >= end + cfg.seal_grace_ms, "sealed").when(_col(now) >= end, "grace").otherwise("open")


def session_interval(start, end, sent, recv, cfg: Config = DEFAULT) -> tuple[Column, Column]:
    """(start, end) on the server's clock. An end after receipt is cut where it also lies after sending, else the whole
    interval moves back."""
    skew = _col(recv) - _col(sent)
    shift = F.when(F.abs(skew) > cfg.skew_dead_band_ms, skew).otherwise(F.lit(0).cast("long"))
    s, e = _col(start) + shift, _col(end) + shift
    over = F.greatest(F.lit(0).cast("long"), e - _col(recv))
    cut = _col(end) > _col(sent)
    return F.least(F.when(cut, s).otherwise(s - over), _col(recv)), F.when(over > 0, _col(recv)).otherwise(e)


def session_duration(start, end, cfg: Config = DEFAULT) -> Column:
    """Trusted length: not negative, not over the cap, not under the least."""
    return F.greatest(F.least(F.greatest(_col(end) - _col(start), F.lit(0).cast("long")), F.lit(cfg.session_cap_min * 60_000).cast("long")), F.lit(cfg.session_min_ms).cast("long"))
