"""WARC records as bytes: one gzip member per record, so that a byte range holds a whole record."""

from __future__ import annotations

import base64
import datetime
import hashlib
import json
import uuid
import zlib

#: Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def sha1_base32(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def now() -> str:
    return datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def _member(raw: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def _record(kind: str, name: str, n: int, date: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """The n-th record of archive `name`, whose id is unique because both are."""
    own = [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, f'{name}/{n}')}>"), ("WARC-Date", date)]
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in own + headers), f"Content-Length: {len(block)}"]
    return _member("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def info(name: str, date: str) -> bytes:
    block = b"software: vacantia\r\nformat: WARC File Format 1.1\r\n"
    return _record("warcinfo", name, 0, date, [("WARC-Filename", name), ("Content-Type", "application/warc-fields")], block)


def _uri(url: str) -> str:
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url)


def page(name: str, n: int, date: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """A response with its payload, or a revisit that has the HTTP headers alone and names the response.

    Page ids, and URLs that a header can't hold as they are, stand in headers of their own.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("Page-ID", "" if page_id is None else str(page_id))]
    if url is not None:
        headers.append(("WARC-Target-URI", _uri(url)))
        if _uri(url) != url or url != url.strip() or not url:
            headers.append(("Page-URL", json.dumps(url)))
    headers += [("WARC-Payload-Digest", sha1_base32(digest)), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is None:
        return _record("response", name, n, date, headers, http + payload)
    headers += [("WARC-Profile", REVISIT_PROFILE), ("Refers-To-Page-ID", str(refers_to))]
    if refers_url is not None:
        headers.append(("WARC-Refers-To-Target-URI", _uri(refers_url)))
    return _record("revisit", name, n, date, headers, http)


def read(member: bytes) -> dict:
    """type, page_id, url, payload_bytes, payload_digest (hex), refers_to of the record in a byte range.

    A response's digest and length are those of its payload, and must be what its headers say.
    """
    raw = zlib.decompress(member, 31)
    head, _, block = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = block[: int(fields["content-length"])]
    if fields["warc-type"] not in ("response", "revisit"):
        return {"type": fields["warc-type"]}
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x.split(b": ")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length: ")))
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    if fields["warc-type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"{fields['warc-record-id']}: the payload isn't what the headers say")
    own = lambda k: int(fields[k]) if fields.get(k) else None
    url = json.loads(fields["page-url"]) if "page-url" in fields else fields.get("warc-target-uri")
    return {"type": fields["warc-type"], "page_id": own("page-id"), "url": url, "payload_bytes": size, "payload_digest": digest, "refers_to": own("refers-to-page-id"), "record_id": fields["warc-record-id"], "date": fields["warc-date"]}


def surt(url: str | None) -> str:
    """The reversed-host key of a URL: `com,example,www)/path?query`, A-Z of the host lower-cased; others as they are."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return url or ""
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, _, port = rest[:cut].translate(_LOWER).partition(":")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (rest[cut:] or "/")
