"""Names of data files. A name states its partition, offsets, time partition, schema and version."""

from __future__ import annotations

import hashlib
import re
import uuid
from dataclasses import dataclass

_NAME = re.compile(
    r"(?P<topic>[^/]+)/data/p=(?P<partition>\d+)/(?P<start>\d+)-(?P<end>\d+)\.t(?P<spec>\d+)(?:_(?P<bucket>-?\d+))?"
    r"\.s(?P<schema>\d+)(?:\.a(?P<hash>[0-9a-f]{16}))?\.v(?P<version>\d+)\.parquet"
)
VERSIONS = (1,)


@dataclass(frozen=True)
class DataFile:
    topic: str
    partition: int
    start: int
    end: int
    spec: int
    bucket: int | None
    schema: int
    hash: str | None = None
    version: int = 1

    def path(self) -> str:
        time = f"t{self.spec}" + ("" if self.bucket is None else f"_{self.bucket}")
        parts = f".a{self.hash}" if self.hash else ""
        return f"{self.topic}/data/p={self.partition}/{self.start}-{self.end}.{time}.s{self.schema}{parts}.v{self.version}.parquet"


def parse(path: str) -> DataFile | None:
    """The file that a path names; None unless the path is exactly how that file is written."""
    m = _NAME.fullmatch(path)
    if not m:
        return None
    g = m.groupdict()
    number = lambda k: int(g[k])
    f = DataFile(g["topic"], number("partition"), number("start"), number("end"), number("spec"), None if g["bucket"] is None else int(g["bucket"]), number("schema"), g["hash"], number("version"))
    limits = f.partition < 1 << 31 and f.end < 1 << 63 and f.spec < 1 << 31 and f.schema < 1 << 31 and (f.bucket is None or -(1 << 31) <= f.bucket < 1 << 31)
    return f if f.start < f.end and limits and f.version in VERSIONS and f.path() == path else None


def assembly_hash(ranges: list[tuple[int, int]]) -> str:
    """Identity of a file put together from parts: 16 hex digits over its parts' offsets."""
    return hashlib.sha256("".join(f"{a}:{b}\n" for a, b in ranges).encode()).hexdigest()[:16]


def tail_snapshot_id(offsets: list[tuple[int, int, int]]) -> int:
    """Id of an uncommitted snapshot, the same for the same (partition, start, end) offsets."""
    digest = hashlib.sha256("".join(f"{p}:{a}:{b}\n" for p, a, b in sorted(offsets)).encode()).digest()
    return (1 << 62) + (int.from_bytes(digest[:8]) & ((1 << 62) - 1))


def view_id(topic_id: str, view: str) -> str:
    """Id of a view of a topic: the same for the same topic, another for each view."""
    return str(uuid.uuid5(uuid.UUID(topic_id), view))
