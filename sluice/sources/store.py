"""What adapters read: pages by address. A live store asks the network, a replay store Parquet files of captured responses."""

from __future__ import annotations

import urllib.error
import urllib.request
from typing import NamedTuple


class Response(NamedTuple):
    url: str
    status: int
    content_type: str
    body: bytes

    @property
    def text(self) -> str:
        return self.body.decode("utf-8", "replace")


class Attempt(NamedTuple):
    """What came of a request: a response, or the status and a word on why there is none."""

    response: Response | None
    status: int | None
    error: str | None


class Store:
    """``attempt`` says why a request failed; ``get`` gives none."""

    def attempt(self, url: str) -> Attempt:
        raise NotImplementedError

    def get(self, url: str) -> Response | None:
        return self.attempt(url).response


class LiveStore(Store):
    """Plain HTTP. Failures are told apart as a status, a timeout, a failed connection or another error."""

    def __init__(self, timeout: float = 30.0, user_agent: str = "sluice"):
        self.timeout, self.user_agent = timeout, user_agent

    def attempt(self, url: str) -> Attempt:
        try:
            request = urllib.request.Request(url, headers={"User-Agent": self.user_agent})
            with urllib.request.urlopen(request, timeout=self.timeout) as r:
                return Attempt(Response(r.url, r.status, r.headers.get_content_type(), r.read()), r.status, None)
        except urllib.error.HTTPError as e:
            return Attempt(None, e.code, f"HTTP {e.code}")
        except (urllib.error.URLError, OSError) as e:
            cause = getattr(e, "reason", e)
            if isinstance(cause, TimeoutError):
                return Attempt(None, None, f"timeout after {self.timeout:g}s")
            return Attempt(None, None, f"connection failed: {cause}")
        except ValueError as e:
            return Attempt(None, None, f"{type(e).__name__}: {e}")


class ReplayStore(Store):
    """Captured responses in Parquet: ``url, status, content_type, body`` and, where requests failed, ``error``. Each request reads only the row groups its address can be in."""

    def __init__(self, path: str):
        import pyarrow.dataset as ds

        self.data = ds.dataset(path)

    def attempt(self, url: str) -> Attempt:
        import pyarrow.dataset as ds

        rows = self.data.to_table(filter=ds.field("url") == url).to_pylist()
        if not rows:
            return Attempt(None, None, "connection failed: not captured")
        r = rows[0]
        if r.get("error") or r["status"] is None:
            return Attempt(None, r["status"], r.get("error") or "no status")
        if r["status"] >= 400:
            return Attempt(None, r["status"], f"HTTP {r['status']}")
        body = r["body"]
        return Attempt(Response(url, r["status"], r["content_type"] or "", body.encode() if isinstance(body, str) else body or b""), r["status"], None)


def open_store(options) -> LiveStore | ReplayStore:
    return ReplayStore(options["replay"]) if options.get("replay") else LiveStore(float(options.get("timeout", 30)))
