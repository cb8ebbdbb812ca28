"""Subscriptions: a table of interests with limits and expiry, and the gates that a query subscription passes."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field, replace

KINDS = ("files", "symbols", "selector", "query")
MOST, MOST_OF_CLIENT, MOST_SELECTORS = 256, 32, 64
TTL, LONGEST_TTL = 3_600, 86_400
INTERVAL_MS, SHORTEST_MS, LONGEST_MS = 2_000, 2_000, 300_000
BUDGET_MS, PAUSE_S = 200, 60
_ID = re.compile(r"[A-Za-z0-9_.:-]{1,64}")


class SubscriptionError(ValueError):
    pass


@dataclass(frozen=True)
class Subscription:
    id: str
    client: str
    kind: str
    spec: str
    expires_at: float
    ttl: int = TTL
    min_interval_ms: int = INTERVAL_MS
    last_hash: str | None = None
    last_set: frozenset = frozenset()
    last_emit_at: float | None = None
    paused_until: float | None = None


@dataclass
class Subscriptions:
    """A registry; times are seconds and are passed in."""

    rows: dict[str, Subscription] = field(default_factory=dict)

    def subscribe(self, client: str, kind: str, spec: str, now: float, ttl: int = TTL, min_interval_ms: int = INTERVAL_MS, id_: str | None = None) -> Subscription:
        if kind not in KINDS:
            raise SubscriptionError(f"unknown interest {kind!r}")
        id_ = id_ or f"sub-{uuid.uuid4().hex[:12]}"
        if not _ID.fullmatch(id_):
            raise SubscriptionError("bad id")
        if not 0 < ttl <= LONGEST_TTL:
            raise SubscriptionError("bad ttl")
        if not SHORTEST_MS <= min_interval_ms <= LONGEST_MS:
            raise SubscriptionError("bad interval")
        if kind == "selector":
            from ..plans.selector import parse

            parse(spec)
        others = [s for s in self.rows.values() if s.id != id_]
        if len(others) >= MOST or sum(s.client == client for s in others) >= MOST_OF_CLIENT or kind == "selector" and sum(s.kind == "selector" for s in others) >= MOST_SELECTORS:
            raise SubscriptionError("too many subscriptions")
        self.rows[id_] = Subscription(id_, client, kind, spec, now + ttl, ttl, min_interval_ms)
        return self.rows[id_]

    def unsubscribe(self, id_: str) -> bool:
        return self.rows.pop(id_, None) is not None

    def evict(self, now: float) -> list[str]:
        """Ids that had expired."""
        gone = [i for i, s in self.rows.items() if s.expires_at <= now]
        for i in gone:
            del self.rows[i]
        return gone

    def drop_client(self, client: str) -> list[str]:
        gone = [i for i, s in self.rows.items() if s.client == client]
        for i in gone:
            del self.rows[i]
        return gone

    def status(self, now: float, id_: str | None = None) -> list[dict]:
        return [{"id": s.id, "kind": s.kind, "spec": s.spec, "seconds_until_expiry": max(0, int(s.expires_at - now))} for s in sorted(self.rows.values(), key=lambda s: s.id) if id_ in (None, s.id)]

    def gate(self, id_: str, now: float, symbols_changed: bool, evaluate) -> tuple[str, list[str] | None]:
        """(outcome, result): paused, too_soon, unchanged_graph, over_budget, same_result or emitted. evaluate() -> (paths, milliseconds)."""
        s = self.rows[id_]
        if s.paused_until is not None and now < s.paused_until:
            return "paused", None
        if s.last_emit_at is not None and (now - s.last_emit_at) * 1000 < s.min_interval_ms:
            return "too_soon", None
        if not symbols_changed:
            return "unchanged_graph", None
        paths, took_ms = evaluate()
        if took_ms > BUDGET_MS:
            self.rows[id_] = replace(s, paused_until=now + PAUSE_S)
            return "over_budget", None
        from hashlib import sha256

        found = sorted(set(paths))
        digest = sha256("\n".join(found).encode()).hexdigest()
        if digest == s.last_hash:
            return "same_result", None
        self.rows[id_] = replace(s, last_hash=digest, last_set=frozenset(found), last_emit_at=now, paused_until=None, expires_at=now + s.ttl)
        return "emitted", found
