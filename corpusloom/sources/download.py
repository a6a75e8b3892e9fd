"""Byte ranges of a remote file fetched in parallel, resumed where they stopped, and verified as a whole."""

from __future__ import annotations

import fcntl
import hashlib
import os
import shutil
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

#: Opens a URL's bytes from the first to the last position and returns an object to ``read`` from, or raises ``OSError``.
Opener = Callable[[str, int, int], object]


def http_opener(timeout: float = 60.0) -> Opener:
    """An opener over HTTP that takes nothing but the range asked for."""
    from urllib.request import Request, urlopen

    def open_range(url: str, first: int, last: int):
        answer = urlopen(Request(url, headers={"Range": f"bytes={first}-{last}"}), timeout=timeout)
        said = answer.headers.get("Content-Range", "")
        if answer.status != 206 or not said.startswith(f"bytes {first}-{last}/"):
            raise ValueError(f"asked for bytes {first}-{last}, got status {answer.status} and {said!r}")
        return answer

    return open_range


def fetch(url: str, target: str, size: int, sha256: str, opener: Opener, part_bytes: int = 64 << 20, workers: int = 8, attempts: int = 8, pause: float = 1.0) -> str:
    """Bring ``url`` to ``target`` and return the path; what is left of an earlier try is taken up.

    Each part is a file of its own that only grows.  One process at a time may
    work on a target.  A target that is there already must be the file itself;
    otherwise, and where the whole isn't of the size and hash expected, it raises
    and the target does not appear.
    """
    if size <= 0 or part_bytes <= 0 or workers <= 0 or attempts <= 0 or len(sha256) != 64:
        raise ValueError("size, parts, workers, attempts and hash must be set")
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    with open(target + ".lock", "a") as lock:
        try:
            fcntl.flock(lock, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError as e:
            raise RuntimeError(f"{target} is being fetched by another process") from e
        if os.path.exists(target):
            if os.path.getsize(target) == size and _sha256(target) == sha256:
                return target
            raise ValueError(f"{target} is another file")
        folder = target + ".parts"
        os.makedirs(folder, exist_ok=True)
        spans = [(k, min(size, k + part_bytes)) for k in range(0, size, part_bytes)]
        names = [f"{folder}/{first:020d}" for first, _ in spans]
        with ThreadPoolExecutor(workers) as pool:
            list(pool.map(lambda x: _part(url, x[1], *x[0], opener, attempts, pause), zip(spans, names)))
        whole = target + ".whole"
        with open(whole, "wb") as out:
            for n in names:
                with open(n, "rb") as f:
                    shutil.copyfileobj(f, out, 1 << 20)
        if os.path.getsize(whole) != size or _sha256(whole) != sha256:
            raise ValueError(f"{url} isn't of the size and hash expected")
        os.replace(whole, target)
        shutil.rmtree(folder)
    return target


def _part(url: str, path: str, first: int, end: int, opener: Opener, attempts: int, pause: float) -> None:
    for attempt in range(attempts):
        have = os.path.getsize(path) if os.path.exists(path) else 0
        if have > end - first:
            raise ValueError(f"{path} is longer than its range")
        if have == end - first:
            return
        if attempt:
            time.sleep(min(30.0, pause * 2 ** (attempt - 1)))
        try:
            source = opener(url, first + have, end - 1)
            with open(path, "ab") as f:
                shutil.copyfileobj(source, f, 1 << 20)
        except OSError:
            if attempt + 1 == attempts:
                raise
    if os.path.getsize(path) != end - first:
        raise OSError(f"{path} stayed short after {attempts} attempts")


def _sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()
