"""A cuckoo filter over digests: 16-bit fingerprints in buckets of four slots."""

from __future__ import annotations

from array import array
from collections.abc import Iterable

SLOTS = 4
KICKS = 200


class Overflow(Exception):
    """No free slot was found; the caller resizes from its stored keys."""


class CuckooFilter:
    """Each digest lives in one of two buckets, each found from the other and the fingerprint."""

    def __init__(self, buckets: int = 64, cells: bytes | None = None):
        self.buckets = 1 << max(1, (buckets - 1).bit_length())
        self.cells = array("H", cells or bytes(2 * SLOTS * self.buckets))

    @classmethod
    def of(cls, digests: Iterable[bytes], buckets: int = 64) -> CuckooFilter:
        """A filter of all digests, doubled until each finds a place."""
        digests = list(digests)
        made = cls(max(buckets, len(digests) // 3))
        while True:
            try:
                for digest in digests:
                    made.insert(digest)
                return made
            except Overflow:
                made = cls(2 * made.buckets)

    @classmethod
    def opened(cls, cells: bytes) -> CuckooFilter:
        """The filter that ``to_bytes`` has stored, as it was."""
        return cls(len(cells) // (2 * SLOTS), cells)

    def _place(self, digest: bytes) -> tuple[int, int]:
        word = int.from_bytes(digest[:8], "little")
        return (word & 0xFFFF) or 1, (word >> 16) & (self.buckets - 1)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995 >> 7) & (self.buckets - 1))

    def _find(self, digest: bytes) -> int:
        mark, first = self._place(digest)
        for bucket in (first, self._other(first, mark)):
            for cell in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.cells[cell] == mark:
                    return cell
        return -1

    def __contains__(self, digest: bytes) -> bool:
        return self._find(digest) >= 0

    def insert(self, digest: bytes) -> None:
        mark, first = self._place(digest)
        second = self._other(first, mark)
        for bucket in (first, second):
            if self._put(bucket, mark):
                return
        bucket = second
        for kick in range(KICKS):
            cell = bucket * SLOTS + (kick + mark) % SLOTS
            mark, self.cells[cell] = self.cells[cell], mark
            bucket = self._other(bucket, mark)
            if self._put(bucket, mark):
                return
        raise Overflow

    def _put(self, bucket: int, mark: int) -> bool:
        for cell in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if not self.cells[cell]:
                self.cells[cell] = mark
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        """Only for digests that are in the filter, as any cuckoo filter asks."""
        cell = self._find(digest)
        if cell < 0:
            return False
        self.cells[cell] = 0
        return True

    def to_bytes(self) -> bytes:
        return self.cells.tobytes()


class LiveDigests:
    """The stored keys of one bucket behind their cuckoo filter.

    ``entries`` maps a digest to [newest doc_id, rows]; a hit of the filter counts only
    if the digest is among the entries. With ``cells``, the stored filter of these entries is opened;
    it is made anew only where there is none, or where it overflows.
    """

    def __init__(self, entries: dict[bytes, list] | None = None, cells: bytes | None = None):
        self.entries = dict(entries or {})
        self.filter = CuckooFilter.opened(cells) if cells else CuckooFilter.of(self.entries)
        self.resizes = 0
        self.false_hits = 0

    def add(self, digest: bytes, doc_id: int | None, rows: int = 1) -> bool:
        """True if the digest was live already; the larger doc_id then takes its place."""
        if digest in self.filter:
            entry = self.entries.get(digest)
            if entry is not None:
                entry[1] += rows
                if doc_id is not None and (entry[0] is None or doc_id > entry[0]):
                    entry[0] = doc_id
                return True
            self.false_hits += 1
        self.entries[digest] = [doc_id, rows]
        try:
            self.filter.insert(digest)
        except Overflow:
            self.resizes += 1
            self.filter = CuckooFilter.of(self.entries, 2 * self.filter.buckets)
        return False

    def remove(self, digest: bytes) -> bool:
        """False if the digest is not live, whatever the filter says."""
        if digest not in self.filter or digest not in self.entries:
            return False
        del self.entries[digest]
        return self.filter.delete(digest)
