"""Fits over a matrix that the tasks of one barrier job hold between them: each has some whole cells and some whole features.

All tasks run the same fit with the same draws, each over its own entries, and send their results to each other by sockets,
so a step needs no Spark job. Steps and results are those of blocks.py, whichever task holds what.
"""

from __future__ import annotations

import pickle
import secrets
import socket
import struct
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession

from countloom.plans.blocks import BLOCK, Block, Blocks

#: Entries of a task, and numbers of one table of state, items x labels, which every task holds.
HELD, STATE = 12 << 20, 8 << 20


class Ranks:
    """The tasks of a barrier stage, joined by a socket for each two of them."""

    def __init__(self):
        context = BarrierTaskContext.get()
        self.rank, self.size, self.peers = context.partitionId(), len(infos := context.getTaskInfos()), {}
        token = secrets.token_hex(16)
        with socket.create_server(("", 0), backlog=self.size) as server:
            host = infos[self.rank].address.rsplit(":", 1)[0]
            known = [m.split("|") for m in context.allGather(f"{host}|{server.getsockname()[1]}|{token}")]
            for r in range(self.rank):
                peer = socket.create_connection((known[r][0], int(known[r][1])))
                peer.sendall(known[r][2].encode() + struct.pack("<i", self.rank))
                self.peers[r] = peer
            while len(self.peers) < self.size - 1:
                peer = server.accept()[0]
                said = self._read(peer, 36)
                if secrets.compare_digest(bytes(said[:32]), token.encode()):
                    self.peers[struct.unpack("<i", said[32:])[0]] = peer
        for peer in self.peers.values():
            peer.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
        self.sender = ThreadPoolExecutor(1)

    @staticmethod
    def _read(peer: socket.socket, size: int) -> bytearray:
        out = bytearray(size)
        view = memoryview(out)
        while len(view):
            if not (n := peer.recv_into(view)):
                raise ConnectionError("another task of the fit has ended")
            view = view[n:]
        return out

    def swap(self, each: Callable[[int], object]) -> list:
        """each(r) goes to task r; what the tasks have sent here, in their order."""

        def send(r: int) -> None:
            data = pickle.dumps(each(r), 5)
            self.peers[r].sendall(struct.pack("<q", len(data)))
            self.peers[r].sendall(data)

        out = [None] * self.size
        out[self.rank] = each(self.rank)
        for i in range(1, self.size):
            to, of = (self.rank + i) % self.size, (self.rank - i) % self.size
            sent = self.sender.submit(send, to)
            size = struct.unpack("<q", self._read(self.peers[of], 8))[0]
            out[of] = pickle.loads(self._read(self.peers[of], size))
            sent.result()
        return out

    def gather(self, own: object) -> list:
        return self.swap(lambda r: own)

    def close(self) -> None:
        self.sender.shutdown()
        for peer in self.peers.values():
            peer.close()


def _whole(ranks: Ranks, i: np.ndarray, j: np.ndarray, n: np.ndarray, items: int, width: int) -> list[Block]:
    """Blocks of this task's items; tasks have about as many entries each."""
    ends = np.cumsum(sum(ranks.gather(np.bincount(i, minlength=items))))
    cut = np.searchsorted(ends, ends[-1] * np.arange(1, ranks.size) / ranks.size) if items else np.zeros(ranks.size - 1, int)
    of = np.searchsorted(cut, i, "right").astype(np.int16)
    order = np.argsort(of, kind="stable")
    bounds = np.searchsorted(of[order], np.arange(ranks.size + 1))
    own = lambda r: tuple(a[order[bounds[r] : bounds[r + 1]]] for a in (i, j, n))
    i, j, n = (np.concatenate(a) for a in zip(*ranks.swap(own), strict=True))
    del order, of
    if n.dtype.kind == "i" and items * width < 1 << 47 and 0 <= n.min(initial=0) and n.max(initial=0) < 1 << 16:
        key = ((i.astype(np.int64) * width + j) << 16) + n
        del i, j, n
        key.sort()
        n = (key & 0xFFFF).astype(np.int32)
        key >>= 16
        i, j = (key // width).astype(np.int32), (key % width).astype(np.int32)
        del key
    else:
        order = np.argsort(i.astype(np.int64) * width + j)
        i, j, n = i[order], j[order], n[order]
    at, first = np.unique(i, return_index=True)
    return list(Block(at, np.append(first, len(i)), j, n).parts(BLOCK))


class Held(Blocks):
    """Blocks of which each task holds its own; every result is gathered by all of them."""

    def __init__(self, ranks: Ranks, f: np.ndarray, c: np.ndarray, n: np.ndarray, shape: tuple[int, int], kind: type):
        super().__init__((_whole(ranks, f, c, n, shape[0], shape[1]), _whole(ranks, c, f, n, shape[1], shape[0])), shape)
        self.ranks, self.kind = ranks, kind

    def _each(self, axis: int, work, state: dict) -> list[tuple[np.ndarray, np.ndarray]]:
        if self.draw is not None and axis == 0:
            raise ValueError("a redrawn matrix is known by cells only")
        sign = 0
        for k in sorted(state):
            sign = zlib.crc32(np.ascontiguousarray(state[k]), sign)
        own = []
        for b in self.tables[axis]:
            b = Block(b.at, b.first, b.j, b.n.astype(self.kind))
            own.append((b.at, work(b if self.draw is None else b.redrawn(self.draw), state)))
        got = self.ranks.gather((sign, own))
        if any(s != sign for s, _ in got):
            raise RuntimeError("the tasks of a fit have come to different states: are their machines alike?")
        return [x for _, some in got for x in some]


def fits_in(spark: SparkSession, size: int, state: int) -> bool:
    return size <= HELD * spark.sparkContext.defaultParallelism and state <= STATE


def barrier(rows: DataFrame, work: Callable[[Ranks, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, every: bool = False) -> DataFrame:
    """What task 0 (or every task) yields of work(ranks, batches), which all tasks of one barrier stage run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = Ranks()
        for out in work(ranks, batches):
            if every or ranks.rank == 0:
                yield out
        ranks.close()

    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, schema, barrier=True)


def held(counts: DataFrame, ids: dict[str, np.ndarray], work: Callable[[Held], Iterator[pa.RecordBatch]], schema: str, kind: type = np.int64) -> DataFrame:
    """What task 0 yields of work(matrix); counts: (feature_id, cell_id, n); ids: of each axis, in order."""
    sent = counts.sparkSession.sparkContext.broadcast(ids)  # at most STATE of each
    small = np.int32 if kind is np.int64 else kind

    def run(ranks: Ranks, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        got = [[np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, small)]]
        for b in batches:
            for k, c in enumerate(("feature_id", "cell_id")):
                got[k].append(np.searchsorted(own[c], b.column(k).to_numpy(zero_copy_only=False)).astype(np.int32))
            n = b.column(2).to_numpy(zero_copy_only=False)
            got[2].append(n.astype(small) if not len(n) or n.max() < 1 << 31 else n)
        f, c, n = (np.concatenate(a) for a in got)
        del got
        yield from work(Held(ranks, f, c, n, (len(own["feature_id"]), len(own["cell_id"])), kind))

    return barrier(counts.select("feature_id", "cell_id", "n"), run, schema)
