"""Fixed values of the report format and of the stored vocabulary.

Everything here has to equal what existing reports and tables contain, so it is
stated as plain text and kept together.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: report page container ------------------------------------
PAGE_RECORD_TYPE = 1
PAGE_SIGNATURE = b" EMF"
PAGE_SIGNATURE_OFFSET = 40
PAGE_LENGTH_OFFSET = 48
PAGE_HEADER_WINDOW = 56
PAGE_MIN_BYTES = 80
TEXT_RECORD_TYPE = 84
TEXT_RECORD_MIN_BYTES = 76
END_RECORD_TYPE = 14

# --- fixed values: limits -----------------------------------------------------
MAX_FILES_PER_BATCH = 20
MAX_FILE_BYTES = 33_554_432
ERROR_SUMMARY_CHARS = 500
REPORT_EXTENSION = ".qrp"
REPORT_TYPE = "QRP"

# --- fixed values: report texts ----------------------------------------------
COLUMN_HEADERS = (
    "Preço",
    "Desconto",
    "Total Item",
    "Data",
    "Hora",
    "Saidas",
    "Entradas",
    "Anterior",
    "Posterior",
)
COLUMN_TOLERANCE = 75
DECLARED_TOTAL_MARKER = "total de vendas:"
DECLARED_TOTAL_LOOKAHEAD = 5
PRODUCT_PATTERN = r"(?i)^Produto:\s*([0-9]+)\s*-\s*(.+)$"
MANUFACTURER_PATTERN = r"(?i)^Fabricante:\s*(.*)$"
FIELD_PREFIXES = ("produto:", "fabricante:")
SNAPSHOT_PREFIXES = ("data/hora:", "estoque atual:")
SALE_PREFIX = "venda numero:"
SALE_PATTERN = r"(?i)^Venda Numero:\s*([0-9]+)$"
EXPORT_STAMP_PATTERN = r"(?i)^Data/Hora:"
CURRENT_STOCK_PATTERN = r"(?i)^Estoque Atual:\s*"

# --- fixed values: vocabulary ---------------------------------------------------
DIRECTIONS = ("OUT", "IN", "RETURN", "UNKNOWN")
JOB_STATUSES = ("PENDING", "PROCESSING", "SUCCEEDED", "PARTIAL_SUCCESS", "FAILED")
ATTEMPT_STATUSES = ("PENDING", "PROCESSING", "VALID", "WARNING", "INVALID", "FAILED")
FILE_STATUSES = ("PENDING", "PROCESSING", "IMPORTED", "WARNING", "INVALID", "FAILED")
VALIDATION_STATUSES = ("VALID", "WARNING", "INVALID")
PROVENANCE = ("SOURCE_DATA", "CALCULATED_DATA", "INFERRED_DATA")
MESSAGES = {
    "NO_EMF_PAGES": "Nenhuma página EMF reconhecida neste QRP.",
    "NO_EMF_TEXT": "QRP reconhecido sem registros de texto EMF.",
    "PRODUCT_FIELD_MISSING": "Campo Produto não encontrado no relatório.",
    "NO_SALE_ROWS": "Nenhuma linha de venda reconhecida.",
    "INVALID_DATETIME": "Data/hora inválida: ",
}
OVERLAP_RULE = "identity-v1"
OVERLAP_DETAIL = "canonical publication blocked"

# --- fixed values: tolerances -----------------------------------------------------
MONEY_TOLERANCE = "0.01"
QUANTITY_TOLERANCE = "0.001"
OUTLIER_RATIO = "2.2"
CLIP_HEADROOM = "1.25"
SCALE_FLOOR = "0.001"

# --- fixed values: paging ---------------------------------------------------------
DEFAULT_PAGE_SIZE = 20
MAX_PAGE_SIZE = 100
TOP_PRODUCTS = 5
RECENT_SALES = 5


@dataclass(frozen=True)
class ReportProfile:
    """Names written next to every row a report reader produces.

    They are parameters: whoever moves existing tables over passes the names
    those tables already hold.
    """

    source: str = "POS"
    parser_name: str = "audit-report"
    parser_version: str = "audit-report-v1"
    rule_version: str = "audit-report-validation-v1"


DEFAULT_PROFILE = ReportProfile()
