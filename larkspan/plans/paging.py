"""Continuation tokens: signed, expiring, bound to plan and parameters."""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import hmac
import json
import time
from collections.abc import Mapping
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

from larkspan.errors import StaticError

LIFETIME = 900


@dataclass(frozen=True)
class Cursor:
    """The last row's sort tuple, and how many rows came so far."""

    values: tuple[Any, ...]
    seen: int


def _plain(v: Any) -> Any:
    if isinstance(v, dt.datetime | dt.date):
        return {"t": v.isoformat()}
    if isinstance(v, Decimal):
        return {"d": str(v)}
    if isinstance(v, bytes | bytearray):
        return {"b": bytes(v).hex()}
    return v


def _value(v: Any) -> Any:
    if isinstance(v, dict):
        if "t" in v:
            return dt.datetime.fromisoformat(v["t"])
        return Decimal(v["d"]) if "d" in v else bytes.fromhex(v["b"])
    return v


class CursorKey:
    """Seals and opens the cursors of one plan with its parameters."""

    def __init__(self, secret: bytes, plan_hash: str, params: Mapping[str, Any]) -> None:
        bound = json.dumps([plan_hash, {k: _plain(v) for k, v in params.items()}], sort_keys=True, default=str)
        self.key = hmac.new(secret, bound.encode(), hashlib.sha256).digest()

    def seal(self, cursor: Cursor, now: float | None = None) -> str:
        body = json.dumps({"v": [_plain(v) for v in cursor.values], "n": cursor.seen, "t": int(now or time.time())}, separators=(",", ":")).encode()
        return base64.urlsafe_b64encode(hmac.new(self.key, body, hashlib.sha256).digest() + body).decode()

    def open(self, token: str, now: float | None = None) -> Cursor:
        try:
            raw = base64.urlsafe_b64decode(token.encode())
        except ValueError as e:
            raise StaticError("bad_continuation") from e
        mac, body = raw[:32], raw[32:]
        if not hmac.compare_digest(mac, hmac.new(self.key, body, hashlib.sha256).digest()):
            raise StaticError("bad_continuation", "of another query, or changed")
        found = json.loads(body)
        if (now or time.time()) - found["t"] > LIFETIME:
            raise StaticError("expired_continuation")
        return Cursor(tuple(_value(v) for v in found["v"]), found["n"])
