"""Step-up challenges: tokens that bind a principal, action and resource, and end after a while."""

from __future__ import annotations

import hmac

from tidewatch.operators.ledger import Sign

#: Seconds within which a step-up challenge may be answered.
TTL_S = 300
MARK = "|"


def _quoted(text: str) -> str:
    return text.replace("%", "%25").replace(MARK, "%7C").replace(".", "%2E")


def issue(sign: Sign, principal: str, action: str, resource: str, now: float, nonce: str, ttl: float = TTL_S) -> str:
    """The bound values, the end (seconds) and a nonce, then a dot and their signature."""
    body = MARK.join([*map(_quoted, (principal, action, resource)), repr(now + ttl).replace(".", "_"), _quoted(nonce)])
    return f"{body}.{sign(body.encode())}"


def valid(sign: Sign, token: str | None, principal: str, action: str, resource: str, now: float) -> bool:
    """Whether the token was issued for these values and has not ended; malformed tokens are not valid."""
    body, dot, signature = (token or "").rpartition(".")
    parts = body.split(MARK)
    if not dot or len(parts) != 5 or not hmac.compare_digest(sign(body.encode()), signature):
        return False
    try:
        end = float(parts[3].replace("_", "."))
    except ValueError:
        return False
    return parts[:3] == [*map(_quoted, (principal, action, resource))] and now < end
