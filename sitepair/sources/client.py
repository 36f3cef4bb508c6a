"""A polite HTTP client: one request at a time, after a pause, with the site's user agent and cookie."""

from __future__ import annotations

import http.client
import time
import urllib.error
import urllib.request

from .config import Site

TIMEOUT = 40


class _Stay(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_):
        return None


class Client:
    """``request`` gives status, content type and body, or None for a transport error."""

    def __init__(self, site: Site, follow: bool = False, pause=time.sleep):
        self.site, self.pause = site, pause
        self.opener = urllib.request.build_opener(*([] if follow else [_Stay]))

    def headers(self) -> dict[str, str]:
        out = {"User-Agent": self.site.user_agent}
        if self.site.auth_workaround:
            out["Cookie"] = "; ".join(f"{k}={v}" for k, v in self.site.auth_workaround.set.items())
        return out

    def request(self, url: str, method: str = "GET") -> tuple[int, str, bytes] | None:
        self.pause(self.site.polite.delay_ms / 1000)
        asked = urllib.request.Request(url, headers=self.headers(), method=method)
        try:
            with self.opener.open(asked, timeout=TIMEOUT) as got:
                return got.status, got.headers.get_content_type(), got.read()
        except urllib.error.HTTPError as e:
            return e.code, e.headers.get_content_type() if e.headers else "", b""
        except (OSError, http.client.HTTPException):
            return None
