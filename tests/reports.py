"""Synthetic report bytes for tests: header record, text records, end record."""

from __future__ import annotations

import struct

HEADER_X = {
    "Preço": 1000, "Desconto": 1200, "Total Item": 1400, "Data": 1600, "Hora": 1800,
    "Saidas": 2000, "Entradas": 2200, "Anterior": 2400, "Posterior": 2600,
}


def text_record(x: int, y: int, text: str) -> bytes:
    raw = text.encode("utf-16-le")
    size = 76 + len(raw)
    size += -size % 4
    body = bytearray(size)
    struct.pack_into("<II", body, 0, 84, size)
    struct.pack_into("<iiII", body, 36, x, y, len(raw) // 2, 76)
    body[76 : 76 + len(raw)] = raw
    return bytes(body)


def page_bytes(runs: list[tuple[int, int, str]]) -> bytes:
    records = b"".join(text_record(*run) for run in runs) + struct.pack("<IIIII", 14, 20, 0, 0, 20)
    header = bytearray(108)
    struct.pack_into("<II", header, 0, 1, 108)
    header[40:44] = b" EMF"
    struct.pack_into("<I", header, 48, 108 + len(records))
    return bytes(header) + records


def report_bytes(pages: list[list[tuple[int, int, str]]], lead: bytes = b"QRP\x01junk") -> bytes:
    return lead + b"\x07\x07".join(page_bytes(p) for p in pages) + b"tail"


def header_runs(y: int = 50) -> list[tuple[int, int, str]]:
    return [(x, y, name) for name, x in HEADER_X.items()]


def sale_line(y: int, sale: str, cells: dict[str, str], shift: int = 0) -> list[tuple[int, int, str]]:
    return [(100, y, f"Venda Numero: {sale}")] + [(HEADER_X[c] + shift, y, t) for c, t in cells.items()]


def simple_report(product: str, name: str, lines: list[tuple[str, str, str]], declared: str | None = None) -> bytes:
    """lines: (sale, quantity, price); totals are consistent."""
    from decimal import Decimal

    runs = [(10, 10, f"Produto: {product} - {name}"), (10, 20, "Fabricante: CASA"), *header_runs()]
    for i, (sale, quantity, price) in enumerate(lines):
        total = (Decimal(quantity) * Decimal(price)).quantize(Decimal("0.01"))
        runs += sale_line(
            100 + i * 10, sale,
            {"Preço": f"R$ {price}".replace(".", ","), "Desconto": "0", "Total Item": str(total).replace(".", ","),
             "Data": "07/08/2026", "Hora": f"12:22:{i % 60:02d}", "Saidas": quantity.replace(".", ","),
             "Anterior": "100", "Posterior": str(Decimal(100) - Decimal(quantity)).replace(".", ",")},
        )
    if declared is not None:
        runs += [(10, 9000, "Total de Vendas:"), (20, 9000, declared)]
    return report_bytes([runs])
