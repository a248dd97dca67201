"""Table configuration: geometry of pages, retention and indexes, and its checks."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class TableConfig:
    """An append-only table with a strictly rising key.

    ``widths`` are the bytes of each data column, negative for signed ones. Sizes are in bytes,
    retention in pages. Retention is by erase blocks of ``erase_pages`` pages.
    """

    key: str
    columns: tuple[str, ...] = ()
    widths: tuple[int, ...] = (-4,)
    key_width: int = 4
    page_size: int = 512
    data_pages: int = 1000
    erase_pages: int = 4
    index_pages: int = 0
    bitmap_bytes: int = 0
    var_pages: int = 0
    buffer_pages: int = 6
    track_min_max: bool = False
    record_level: bool = False
    extra: dict = field(default_factory=dict)

    @property
    def data_width(self) -> int:
        return sum(abs(w) for w in self.widths)

    @property
    def record_size(self) -> int:
        """Bytes of a record; a blob adds a four-byte reference."""
        return self.key_width + self.data_width + (4 if self.var_pages else 0)

    @property
    def header_size(self) -> int:
        spans = 2 * (self.key_width + self.data_width) if self.track_min_max else 0
        return 6 + (self.bitmap_bytes if self.index_pages else 0) + spans

    @property
    def records_per_page(self) -> int:
        return (self.page_size - self.header_size) // self.record_size

    @property
    def index_entries_per_page(self) -> int:
        return (self.page_size - 16) // self.bitmap_bytes

    @property
    def blob_header_size(self) -> int:
        return 4 + self.key_width

    def problems(self) -> list[str]:
        """What is wrong, in words; nothing for a valid configuration."""
        out = []
        if not 1 <= self.key_width <= 8:
            out.append("a key has 1 to 8 bytes")
        if any(w == 0 or abs(w) > 127 for w in self.widths):
            out.append("a column has 1 to 127 bytes")
        needed = 2 + (2 if self.index_pages else 0) + (2 if self.var_pages else 0)
        if self.buffer_pages < needed:
            out.append(f"{needed} page buffers are needed")
        for name in ("data_pages", "index_pages", "var_pages"):
            pages = getattr(self, name)
            if pages and pages % self.erase_pages:
                out.append(f"{name} isn't a multiple of the erase block")
            if pages and pages < 2 * self.erase_pages:
                out.append(f"{name} is less than two erase blocks")
        if self.record_level and self.data_pages < 4 * self.erase_pages:
            out.append("record-level consistency needs four erase blocks")
        if self.index_pages and not self.bitmap_bytes:
            out.append("an index needs a bitmap width")
        if self.records_per_page < 1:
            out.append("a record doesn't fit in a page")
        return out

    def validated(self) -> TableConfig:
        if found := self.problems():
            raise ValueError("; ".join(found))
        return self
