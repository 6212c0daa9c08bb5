"""What an operation may take: budgets from a limit or the machine's memory, and refusals before work begins."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from helixframe.errors import FormatError, ResourceError

MB = 1 << 20
# Fixed values of the model
LEAST_MB, BUFFER_MB, STACK_MB, MARGIN = 256, 512, 64, 1.2
FIRST_PASS_BYTES, SECOND_PASS_BYTES = 24, 50
DECODE_LEAST_MB, DECODE_MOST_MB = 16, 512 * 1024
MOST_BLOCKS, MOST_READS = 10_000_000, 1_000_000_000
BASES_HINT, BLOCK_LEAST = 256, 64 * 1024


def available_mb(meminfo: str = "/proc/meminfo") -> int:
    """Memory that is free for use; 8192 where the system doesn't say."""
    try:
        for line in Path(meminfo).read_text().splitlines():
            if line.startswith("MemAvailable:"):
                return int(line.split()[1]) // 1024
    except (OSError, ValueError, IndexError):
        pass
    return 8192


def limit_mb(asked: int) -> int:
    """The asked limit; 0 is three quarters of what is available."""
    return asked or int(available_mb() * 0.75)


@dataclass(frozen=True)
class MemoryBudget:
    total_mb: int
    buffer_mb: int
    stack_mb: int = STACK_MB

    @classmethod
    def of(cls, asked_mb: int) -> MemoryBudget:
        total = max(LEAST_MB, asked_mb)
        return cls(total, min(BUFFER_MB, total // 16))

    @property
    def second_pass_bytes(self) -> int:
        used = self.buffer_mb + self.stack_mb
        return (self.total_mb - used if self.total_mb > used else LEAST_MB) * MB

    def block_reads(self, threads: int) -> int:
        return max(1000, min(500_000, int(self.second_pass_bytes / (threads * MARGIN)) // SECOND_PASS_BYTES))


@dataclass(frozen=True)
class DecodeBudget:
    """Limits of one decode or verification."""

    limit: int
    automatic: bool = False

    @classmethod
    def resolve(cls, asked_mb: int = 0) -> DecodeBudget:
        return cls(min(DECODE_MOST_MB, max(DECODE_LEAST_MB, limit_mb(asked_mb))) * MB, asked_mb == 0)

    @property
    def allocation(self) -> int:
        return max(MB, self.limit // 2)

    @property
    def blocks(self) -> int:
        return max(1, min(MOST_BLOCKS, self.limit // 64))

    @property
    def reads(self) -> int:
        return max(1, min(MOST_READS, self.limit // 32))

    @staticmethod
    def _refuse(what: str, declared: int, allowed: int) -> None:
        if declared > allowed:
            raise ResourceError(f"{what}: {declared} is more than {allowed}")

    def check_allocation(self, declared: int, what: str = "allocation") -> None:
        self._refuse(what, declared, self.allocation)

    def check_index(self, blocks: int, region: int, entry: int) -> None:
        self._refuse("blocks", blocks, self.blocks)
        if entry <= 0:
            raise FormatError("an index entry has no bytes")
        self._refuse("blocks in the index's region", blocks, region // entry)
        self.check_allocation(blocks * entry, "index")

    def check_reads(self, declared: int) -> None:
        self._refuse("reads", declared, self.reads)

    def original_order_peak(self, reads: int, largest_block: int, bases: int = BASES_HINT) -> int:
        """Both maps, all reads and one block."""
        return 16 * reads + reads * (2 * bases + 128) + 2 * largest_block

    def check_original_order(self, reads: int, largest_block: int, bases: int = BASES_HINT) -> None:
        self._refuse("original order", self.original_order_peak(reads, largest_block, bases), self.limit)

    def check_block(self, compressed: int) -> None:
        self._refuse("one block's decoding", 3 * compressed, self.limit)

    def batch(self, threads: int, compressed: int) -> int:
        """Blocks that may be decoded at once."""
        each = 3 * max(BLOCK_LEAST, compressed)
        self._refuse("one block's decoding", each, self.limit)
        return min(2 * max(1, threads), max(1, self.limit // each), 64)


@dataclass(frozen=True)
class Chunking:
    """How reads beyond the memory are cut; Spark cuts by partitions, so this is a plan to look at."""

    chunks: int
    reads_per_chunk: int
    block_reads: int
    blocks_per_chunk: int
    peak_mb: int

    @classmethod
    def of(cls, reads: int, mean_length: int, block_reads: int, threads: int, asked_mb: int = 0) -> Chunking:
        up = lambda a, b: -(-a // b)
        room = max(LEAST_MB, limit_mb(asked_mb))
        each = FIRST_PASS_BYTES + 3 * mean_length + 80
        first = reads * each // MB
        chunks = 1 if first <= room else max(2, up(first, room))
        per = up(reads, chunks)
        blocks = up(per, block_reads)
        second = block_reads * SECOND_PASS_BYTES // MB * min(threads, blocks)
        return cls(chunks, per, block_reads, blocks, max(per * each // MB, second) + BUFFER_MB + STACK_MB * threads)

    def __str__(self) -> str:
        if self.chunks == 1:
            return f"one pass of {self.reads_per_chunk} reads, about {self.peak_mb} MB"
        return f"{self.chunks} chunks of {self.reads_per_chunk} reads in {self.blocks_per_chunk} blocks, about {self.peak_mb} MB"
