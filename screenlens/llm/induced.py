"""External induced sorting of the suffixes of one shard, with common-prefix values.

The text is a file mapped into memory. Suffix tuples (position, common prefix with the suffix
scanned before) wait in priority queues that are ordered by first byte and arrival; beyond a limit
their pieces lie on disk. A pass takes them in order, in blocks of bounded size, and induces the
suffixes that start one byte earlier: from left to right those of type L, then from right to left
those of type S. A suffix's common prefix with the one induced before it is one more than the least
value scanned since then.

The first two passes sort the substrings between leftmost-S positions. Their names form the reduced
string. Its alphabet is as large as the string, where queues by byte do not apply, so it is not induced in turn but
sorted by doubling over groups of names that still tie; the last two passes induce all suffixes from it. Sorting goes as
deep as `cap` bytes, all that the caller asks about.

All arrays of the shard's length (positions, order, ranks, common prefixes) are files mapped into memory once they
exceed `limit` bytes, and are worked on in blocks; memory is needed for some blocks, the queues' limit, and
the largest group of names that tie.
"""

from __future__ import annotations

import tempfile

import numpy as np

BLOCK = 1 << 20
#: Bytes of tuples that a queue holds in memory.
HELD = 64 << 20
FAR = 255


def array(n: int, kind, limit: int) -> np.ndarray:
    """Room for n values: in memory up to the limit, else in an unlinked file."""
    if n * np.dtype(kind).itemsize <= limit:
        return np.empty(n, dtype=kind)
    return np.memmap(tempfile.TemporaryFile(), dtype=kind, mode="w+", shape=(n,))


def spans(n: int, size: int):
    """(start, end) of blocks."""
    for k in range(0, n, size):
        yield k, min(k + size, n)


class Positions:
    """Positions that are appended in descending order, and read in ascending order."""

    def __init__(self, limit: int):
        self.limit, self.n, self.file = limit, 0, tempfile.SpooledTemporaryFile(max_size=limit)

    def append(self, pos: np.ndarray) -> None:
        self.file.write(np.ascontiguousarray(pos, dtype=np.int64).tobytes())
        self.n += len(pos)

    def ascending(self) -> np.ndarray:
        out = array(self.n, np.int64, self.limit)
        for s, e in spans(self.n, BLOCK):
            self.file.seek(8 * (self.n - e))
            out[s:e] = np.frombuffer(self.file.read(8 * (e - s)), dtype=np.int64)[::-1]
        self.file.close()
        return out


class SuffixQueue:
    """Tuples by first byte, in order of arrival; pieces beyond the limit are on disk."""

    def __init__(self, limit: int = HELD):
        self.pieces: list[list] = [[] for _ in range(256)]
        self.limit, self.held, self.file = limit, 0, None

    def push(self, c: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        size = pos.nbytes + lcp.nbytes
        if self.held + size <= self.limit:
            self.held += size
            self.pieces[c].append((pos, lcp))
            return
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        at = self.file.seek(0, 2)
        self.file.write(pos.tobytes())
        self.file.write(lcp.tobytes())
        self.pieces[c].append((at, len(pos)))

    def load(self, piece) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(piece[0], np.ndarray):
            self.held -= piece[0].nbytes + piece[1].nbytes
            return piece
        self.file.seek(piece[0])
        return np.frombuffer(self.file.read(8 * piece[1]), dtype=np.int64), np.frombuffer(self.file.read(piece[1]), dtype=np.uint8)

    def take(self, c: int, last: bool = False):
        """The next block of a byte's tuples, or None; last: from the end, in reverse."""
        pos, lcp, n = [], [], 0
        while self.pieces[c] and n < BLOCK:
            p, v = self.load(self.pieces[c].pop(-1 if last else 0))
            pos.append(p[::-1] if last else p)
            lcp.append(v[::-1] if last else v)
            n += len(p)
        if not pos:
            return None
        return (pos[0], lcp[0]) if len(pos) == 1 else (np.concatenate(pos), np.concatenate(lcp))


class Inducer:
    def __init__(self, text: np.ndarray, cap: int, limit: int = HELD):
        """text: bytes (perhaps mapped) in which 255 parts strings and ends the last; 254 must not occur."""
        if cap >= FAR:
            raise ValueError("cap must be under 255")
        self.t, self.cap, self.limit, self.n = text, cap, limit, len(text)

    # comparing

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of pairs of suffixes, `cap` at most."""
        out = np.zeros(len(a), dtype=np.uint8)
        live = np.arange(len(a))
        step = np.arange(8)
        for j in range(0, self.cap, 8):
            x, y = (self._eight(p[live] + j, step) for p in (a, b))
            diff = x ^ y
            same = diff == 0
            low = diff & (~diff + np.uint64(1))
            bytes_ = np.where(same, 8, np.bitwise_count(low - np.uint64(1)) // 8)
            out[live] = np.minimum(j + bytes_, self.cap)
            live = live[same]
            if not len(live):
                break
        return out

    def _eight(self, p: np.ndarray, step: np.ndarray) -> np.ndarray:
        at = p[:, None] + step
        got = self.t[np.minimum(at, self.n - 1)]
        got[at >= self.n] = 254
        return np.ascontiguousarray(got).view("<u8").reshape(-1)

    # passes

    def _scan(self, queue: SuffixQueue, state, pos, lcp, keep) -> None:
        """Induce the predecessors of a block; keep(byte before) tells which."""
        least, begun = state
        before = self.t[np.maximum(pos - 1, 0)]
        ok = keep(before) & (pos > 0)
        c = np.where(ok, before.astype(np.uint16), np.uint16(256))
        order = np.argsort(c, kind="stable")
        count = np.bincount(c, minlength=257)
        ends = np.cumsum(count)
        low = int(lcp.min())
        np.minimum(least, low, out=least, where=count[:256] == 0)
        for b in np.flatnonzero(count[:256]).tolist():
            at = order[ends[b] - count[b] : ends[b]]
            starts = np.empty(len(at), dtype=np.int64)
            starts[0] = 0
            starts[1:] = at[:-1] + 1
            found = np.minimum.reduceat(lcp[: at[-1] + 1], starts)
            found[0] = min(int(found[0]), int(least[b]))
            found = np.minimum(found, self.cap - 1) + np.uint8(1)
            if not begun[b]:
                begun[b], found[0] = True, 0
            queue.push(b, pos[at] - 1, found)
            rest = lcp[at[-1] + 1 :]
            least[b] = rest.min() if len(rest) else FAR

    def passes(self, seeds: np.ndarray, seed_lcp: np.ndarray, sink, blank: bool) -> None:
        """Both passes. seeds: leftmost-S positions in order of their first byte at least; sink(pos, lcp) gets all suffixes from the last to the first. blank: no common prefixes are asked for."""
        t = self.t
        queue, kept = SuffixQueue(self.limit), SuffixQueue(self.limit)
        state = np.full(256, FAR, dtype=np.uint8), np.zeros(256, dtype=bool)
        self._scan(queue, state, np.array([self.n]), np.zeros(1, np.uint8), lambda b: b >= 0)
        cut = np.append(0, np.cumsum(sum((np.bincount(t[seeds[s:e]], minlength=256) for s, e in spans(len(seeds), BLOCK)), np.zeros(256, np.int64))))
        last_l = np.full(256, -1, dtype=np.int64)
        for c in range(256):
            while (block := queue.take(c)) is not None:
                kept.push(c, *block)
                last_l[c] = block[0][-1]
                self._scan(queue, state, *block, lambda b, c=c: b >= c)
            for k in range(cut[c], cut[c + 1], BLOCK):
                e = min(k + BLOCK, cut[c + 1])
                lcp = np.array(seed_lcp[k:e])
                if k == cut[c]:
                    lcp[0] = self.common(last_l[c : c + 1], seeds[k : k + 1])[0] if last_l[c] >= 0 and not blank else 0
                self._scan(queue, state, np.asarray(seeds[k:e]), lcp, lambda b, c=c: b > c)
        queue = SuffixQueue(self.limit)
        state = np.full(256, FAR, dtype=np.uint8), np.zeros(256, dtype=bool)
        for c in range(255, -1, -1):
            leftmost = -1
            while (block := queue.take(c)) is not None:
                sink(*block, True)
                leftmost = int(block[0][-1])
                self._scan(queue, state, *block, lambda b, c=c: b <= c)
            # From the right, a tuple's value is that of its right neighbour.
            follow = 0 if leftmost < 0 or last_l[c] < 0 or blank else int(self.common(np.array([leftmost]), last_l[c : c + 1])[0])
            while (block := kept.take(c, last=True)) is not None:
                pos, own = block
                lcp = np.empty(len(own), dtype=np.uint8)
                lcp[0], lcp[1:] = follow, own[:-1]
                follow = int(own[-1])
                sink(pos, lcp, False)
                self._scan(queue, state, pos, lcp, lambda b, c=c: b < c)

    # recursion

    def leftmost(self) -> np.ndarray:
        """Positions of type S whose predecessor is of type L, ascending; read in blocks from the end."""
        found, right, is_s = Positions(self.limit), None, False
        for e in range(self.n, 0, -BLOCK):
            s = max(0, e - BLOCK)
            part = np.asarray(self.t[s:e]).astype(np.int16)
            nxt = np.append(part[1:], -1 if right is None else right)
            d = np.sign(nxt - part)
            if right is not None and d[-1] == 0 or right is None:
                d[-1] = d[-1] if d[-1] else (1 if is_s else -1)
            # Equal bytes take the type of the next unequal one.
            place = np.where(d != 0, np.arange(len(d)), len(d))
            place = np.minimum.accumulate(place[::-1])[::-1]
            kind = d[np.minimum(place, len(d) - 1)] > 0
            before = int(self.t[s - 1]) if s else -1
            prior = np.append(before, part[:-1])
            # A predecessor is of type L if its byte is greater, or equal with this one of type L.
            found.append((np.flatnonzero(kind & (prior > part)) + s)[::-1])
            right, is_s = int(part[0]), bool(kind[0])
        return found.ascending()

    def by_byte(self, seeds: np.ndarray) -> np.ndarray:
        """Positions in order of their bytes, and for one byte as they come."""
        at = np.zeros(256, np.int64)
        for s, e in spans(len(seeds), BLOCK):
            at += np.bincount(self.t[seeds[s:e]], minlength=256)
        at = np.cumsum(at) - at
        out = array(len(seeds), np.int64, self.limit)
        for s, e in spans(len(seeds), BLOCK):
            part = np.asarray(seeds[s:e])
            byte = self.t[part]
            o = np.argsort(byte, kind="stable")
            n = np.bincount(byte, minlength=256)
            out[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(len(part))] = part[o]
            at += n
        return out

    def names(self, order: np.ndarray, all_seeds: np.ndarray) -> np.ndarray:
        """Whether each leftmost-S substring, in sorted order, differs from the one before."""
        m = len(order)
        new = array(m, bool, self.limit)
        new[:1] = True

        def limit(pos):
            k = np.searchsorted(all_seeds, pos) + 1
            end = np.where(k < m, all_seeds[np.minimum(k, m - 1)], self.n)
            return np.minimum(end - pos + 1, self.cap)

        for s, e in spans(m - 1, BLOCK):
            a, b = np.asarray(order[s:e]), np.asarray(order[s + 1 : e + 1])
            x, y = limit(a), limit(b)
            new[s + 1 : e + 1] = (x != y) | (self.common(a, b) < x)
        return new

    def reduced(self, order: np.ndarray, new: np.ndarray, all_seeds: np.ndarray) -> np.ndarray:
        """Sort the suffixes of the reduced string: pairs of names, then of pairs, for groups that tie."""
        m = len(order)
        sa, rank = array(m, np.int64, self.limit), array(m, np.int64, self.limit)
        first = 0
        for s, e in spans(m, BLOCK):
            sa[s:e] = np.searchsorted(all_seeds, order[s:e])
            begins = np.where(new[s:e], np.arange(s, e), 0)
            begins[0] = max(int(begins[0]), first)
            begins = np.maximum.accumulate(begins)
            rank[sa[s:e]] = begins
            first = int(begins[-1])
        h = 1
        # Each name stands for two bytes or more. A group's finer ranks may be seen by later groups: they order the same.
        while 2 * h < self.cap + 2:
            some = False
            for s, e in self.groups(new):
                lead = np.maximum.accumulate(np.where(new[s:e], np.arange(s, e), 0))
                size = np.bincount(lead - s, minlength=e - s)
                at = np.flatnonzero(size[lead - s] > 1)
                if not len(at):
                    continue
                some = True
                one, x = lead[at], np.asarray(sa[s:e])[at]
                two = np.where(x + h < m, rank[np.minimum(x + h, m - 1)], -1)
                o = np.lexsort((two, one))
                x, one, two = x[o], one[o], two[o]
                begin = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))
                sa[s + at], new[s + at] = x, begin
                rank[x] = s + at[np.flatnonzero(begin)[np.cumsum(begin) - 1]]
            if not some:
                break
            h *= 2
        for s, e in spans(m, BLOCK):
            sa[s:e] = all_seeds[sa[s:e]]
        return sa

    def groups(self, new: np.ndarray):
        """(start, end) of blocks that end where a group ends."""
        s, m = 0, len(new)
        while s < m:
            e = min(s + BLOCK, m)
            while e < m:
                k = np.flatnonzero(new[e : e + BLOCK])
                if len(k):
                    e += int(k[0])
                    break
                e = min(e + BLOCK, m)
            yield s, e
            s = e

    def run(self, sink) -> None:
        """sink(positions, common prefix with the suffix given before) gets all suffixes from the last to the first."""
        if not self.n:
            return
        seeds = self.leftmost()
        blank = np.broadcast_to(np.uint8(0), len(seeds))
        got = Positions(self.limit)

        def collect(pos, _, of_s):
            if of_s and len(pos):
                before = self.t[np.maximum(pos - 1, 0)]
                got.append(pos[(before > self.t[pos]) & (pos > 0)])

        self.passes(self.by_byte(seeds), blank, collect, True)
        if got.n != len(seeds):
            raise AssertionError("induction lost suffixes")
        order = got.ascending()
        if len(order) > 1:
            order = self.reduced(order, self.names(order, seeds), seeds)
        lcp = array(len(order), np.uint8, self.limit)
        lcp[:1] = 0
        for s, e in spans(len(order) - 1, BLOCK):
            lcp[s + 1 : e + 1] = self.common(np.asarray(order[s:e]), np.asarray(order[s + 1 : e + 1]))
        self.passes(order, lcp, lambda pos, v, _: sink(pos, v), False)


def mapped(parts) -> np.ndarray:
    """The bytes of all parts, each ended by 255, in an unlinked file mapped into memory."""
    f = tempfile.TemporaryFile()
    n = 0
    for p in parts:
        f.write(p)
        f.write(b"\xff")
        n += len(p) + 1
    f.flush()
    return np.memmap(f, dtype=np.uint8, mode="r", shape=(n,)) if n else np.zeros(0, np.uint8)
