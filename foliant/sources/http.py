"""Polite fetching on the driver: one request at a time, spaced, retried, bounded. Not a distributed operation."""

from __future__ import annotations

import email.utils
import gzip
import threading
import time
import zlib
from collections.abc import Callable
from datetime import datetime, timezone

from foliant.errors import SourceUnavailable

RETRYABLE = {406, 429, 500, 502, 503, 504}


def retry_after(value: str | None, now: datetime) -> float | None:
    """Seconds from a number or an HTTP date, never negative; null if it is neither."""
    if not value:
        return None
    try:
        return max(0.0, float(value))
    except ValueError:
        pass
    try:
        at = email.utils.parsedate_to_datetime(value)
    except (TypeError, ValueError):
        return None
    return max(0.0, ((at if at.tzinfo else at.replace(tzinfo=timezone.utc)) - now).total_seconds())


def decoded(body: bytes, headers: dict[str, str]) -> tuple[bytes, dict[str, str]]:
    """A body without its gzip encoding, and the headers without what was true of the encoded one only."""
    if headers.get("content-encoding", "").strip().lower() not in ("gzip", "x-gzip"):
        return body, headers
    try:
        return gzip.decompress(body), {k: v for k, v in headers.items() if k not in ("content-encoding", "content-length")}
    except (OSError, EOFError, zlib.error) as e:
        raise OSError(f"broken gzip body: {e}") from e


class PoliteClient:
    """`send(url)` returns (status, headers, chunks of bytes). Starts of requests are `delay` seconds apart; a pause
    that the server asks for holds for all."""

    def __init__(self, send: Callable, delay: float = 3.0, retries: int = 4, max_bytes: int = 200 * 2**20, clock=time.monotonic, sleep=time.sleep):
        self.send, self.delay, self.retries, self.max_bytes, self.clock, self.sleep = send, delay, retries, max_bytes, clock, sleep
        self.next_start, self.lock = 0.0, threading.Lock()

    def get(self, url: str) -> bytes:
        """The body; raises after the last retry, for a body shorter than announced, or beyond `max_bytes`."""
        problem = "no answer"
        with self.lock:
            for attempt in range(self.retries + 1):
                wait = self.next_start - self.clock()
                if wait > 0:
                    self.sleep(wait)
                self.next_start = self.clock() + self.delay
                try:
                    status, headers, chunks = self.send(url)
                    headers = {k.lower(): v for k, v in headers.items()}
                    if status == 200:
                        body = b""
                        for c in chunks:
                            body += c
                            if len(body) > self.max_bytes:
                                raise SourceUnavailable(f"{url} is larger than {self.max_bytes} bytes")
                        announced = headers.get("content-length")
                        if announced and "content-encoding" not in headers and len(body) < int(announced):
                            problem = f"truncated body ({len(body)} of {announced} bytes)"
                            continue
                        return decoded(body, headers)[0]
                    if status not in RETRYABLE:
                        raise SourceUnavailable(f"{url} answered {status}")
                    problem = f"status {status}"
                    asked = retry_after(headers.get("retry-after"), datetime.now(timezone.utc))
                    self.next_start = max(self.next_start, self.clock() + (asked if asked is not None else min(60.0, 2.0**attempt)))
                except OSError as e:
                    problem = str(e)
                    self.next_start = max(self.next_start, self.clock() + min(60.0, 2.0**attempt))
        raise SourceUnavailable(f"{url}: {problem}")
