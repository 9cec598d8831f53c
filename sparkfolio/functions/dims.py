"""Constant dimensions: the statement schema, its identities, name variants and page vocabularies.

All tables here are fixed values of the data model, stated in natural order.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# The 27 rows of the asset schema (classification, subclassification, item).
SCHEMA = (
    ("Current Assets", "", "Current Assets"),
    ("Current Assets", "Quick Assets", "Quick Assets"),
    ("Current Assets", "Quick Assets", "Cash & Cash Equivalents"),
    ("Current Assets", "Quick Assets", "Accounts Receivable - Trade"),
    ("Current Assets", "Quick Assets", "Other Quick Assets"),
    ("Current Assets", "", "Inventories, Net"),
    ("Current Assets", "Other Current Assets", "Other Current Assets (subtotal)"),
    ("Current Assets", "Other Current Assets", "Marketable Securities"),
    ("Current Assets", "Other Current Assets", "Short-term Loan"),
    ("Current Assets", "Other Current Assets", "Advance Payments"),
    ("Current Assets", "Other Current Assets", "Other Current Assets"),
    ("Fixed Assets", "", "Fixed Assets"),
    ("Fixed Assets", "Tangible Assets", "Tangible Assets"),
    ("Fixed Assets", "Tangible Assets", "Land"),
    ("Fixed Assets", "Tangible Assets", "Buildings"),
    ("Fixed Assets", "Tangible Assets", "Plant & Machinery"),
    ("Fixed Assets", "Tangible Assets", "Construction in Progress"),
    ("Fixed Assets", "Tangible Assets", "Other Equipment"),
    ("Fixed Assets", "Tangible Assets", "Accumulated Depreciation"),
    ("Fixed Assets", "", "Intangible Assets"),
    ("Fixed Assets", "Financial Assets", "Financial Assets"),
    ("Fixed Assets", "Financial Assets", "Investments"),
    ("Fixed Assets", "Financial Assets", "Long-term Loan"),
    ("Fixed Assets", "Financial Assets", "Other Financial Assets"),
    ("Fixed Assets", "", "Other Fixed Assets"),
    ("Deferred Charges", "", "Deferred Charges"),
    ("Total Assets", "", "Total Assets"),
)
ITEMS = tuple(item for _, _, item in SCHEMA)

# What the schema says of each of its rows, in their order.
DESCRIPTIONS = (
    "Quick Assets + Inventories, Net + Other Current Assets",
    "Cash & Cash Equivalents + Accounts Receivable - Trade + Other Quick Assets",
    "Cash and assets immediately convertible to cash.",
    "Trade receivables arising from sales to customers.",
    "Other short-term liquid assets that belong in Quick Assets.",
    "Inventory held for sale or use in production, net of applicable allowances.",
    "Marketable Securities + Short-term Loan + Advance Payments + Other Current Assets",
    "Current marketable or tradable securities.",
    "Loan receivable expected to be collected within one year.",
    "Amounts paid in advance that are classified as current assets.",
    "Other current assets not classified in the preceding requested fields.",
    "Tangible Assets + Intangible Assets + Financial Assets + Other Fixed Assets",
    "Land + Buildings + Plant & Machinery + Construction in Progress + Other Equipment + Accumulated Depreciation",
    "Owned land classified as tangible fixed assets.",
    "Buildings such as offices, factories and warehouses.",
    "Production and operating plant and machinery.",
    "Tangible assets under construction.",
    "Other equipment and fixtures classified as tangible fixed assets.",
    "Cumulative depreciation deducted from tangible assets. Preserve the negative sign.",
    "Non-physical long-lived assets.",
    "Investments + Long-term Loan + Other Financial Assets",
    "Long-term investments classified as financial assets.",
    "Loan receivable expected to be collected after one year.",
    "Other long-term financial assets not classified above.",
    "Other long-lived assets not classified in tangible, intangible or financial assets.",
    "Deferred costs recognized across accounting periods.",
    "Current Assets + Fixed Assets + Deferred Charges",
)

# The subtotal identities, total = sum of parts.
IDENTITIES = (
    ("Quick Assets", ("Cash & Cash Equivalents", "Accounts Receivable - Trade", "Other Quick Assets")),
    ("Other Current Assets (subtotal)", ("Marketable Securities", "Short-term Loan", "Advance Payments", "Other Current Assets")),
    ("Current Assets", ("Quick Assets", "Inventories, Net", "Other Current Assets (subtotal)")),
    ("Tangible Assets", ("Land", "Buildings", "Plant & Machinery", "Construction in Progress", "Other Equipment", "Accumulated Depreciation")),
    ("Financial Assets", ("Investments", "Long-term Loan", "Other Financial Assets")),
    ("Fixed Assets", ("Tangible Assets", "Intangible Assets", "Financial Assets", "Other Fixed Assets")),
    ("Total Assets", ("Current Assets", "Fixed Assets", "Deferred Charges")),
)

# Item-name variants (folded) and what they stand for.
ALIASES = (
    ("other current assets subtotal", "Other Current Assets (subtotal)"),
    ("other current assets total", "Other Current Assets (subtotal)"),
    ("subtotal other current assets", "Other Current Assets (subtotal)"),
    ("total other current assets", "Other Current Assets (subtotal)"),
    ("accounts receivable trade", "Accounts Receivable - Trade"),
    ("accounts receivable", "Accounts Receivable - Trade"),
    ("trade receivables", "Accounts Receivable - Trade"),
    ("cash and cash equivalents", "Cash & Cash Equivalents"),
    ("cash cash equivalents", "Cash & Cash Equivalents"),
    ("inventories net", "Inventories, Net"),
    ("inventories", "Inventories, Net"),
    ("plant and machinery", "Plant & Machinery"),
    ("plant machinery", "Plant & Machinery"),
    ("machinery and equipment", "Plant & Machinery"),
    ("less accumulated depreciation", "Accumulated Depreciation"),
    ("short term loan", "Short-term Loan"),
    ("long term loan", "Long-term Loan"),
    ("construction in process", "Construction in Progress"),
)

# Strategies (key, prefix, parser, experiment, OCR) and providers.
STRATEGIES = (
    ("s1", "S1", "pypdf", "no_ocr", "off"),
    ("s1-pymupdf", "S1PM", "pymupdf", "no_ocr", "off"),
    ("s1-docling", "S1DL", "docling", "no_ocr", "off"),
    ("s1-inspector", "S1FC", "inspector", "no_ocr", "off"),
    ("s2-pypdf", "S2PY", "pypdf", "ocr", "force"),
    ("s2", "S2", "pymupdf", "ocr", "adaptive"),
    ("s2-docling", "S2DL", "docling", "ocr", "force"),
    ("s2-inspector", "S2FC", "inspector", "ocr", "adaptive"),
    ("s3", "S3", "inspector-gate", "intelligent_scan", "adaptive"),
)


# Japanese names of the schema's items and classes.
JAPANESE = (
    ("Current Assets", "流動資産"),
    ("Quick Assets", "短期投資"),
    ("Cash & Cash Equivalents", "現金及び現金同等物"),
    ("Accounts Receivable - Trade", "売掛金"),
    ("Other Quick Assets", "その他の短期投資"),
    ("Inventories, Net", "棚卸資産"),
    ("Other Current Assets", "その他の流動資産"),
    ("Other Current Assets (subtotal)", "その他の流動資産（小計）"),
    ("Marketable Securities", "有価証券"),
    ("Short-term Loan", "短期貸付金"),
    ("Advance Payments", "前払金"),
    ("Fixed Assets", "固定資産"),
    ("Tangible Assets", "有形固定資産"),
    ("Land", "土地"),
    ("Buildings", "建物"),
    ("Plant & Machinery", "機械装置"),
    ("Construction in Progress", "建設仮勘定"),
    ("Other Equipment", "その他の設備"),
    ("Accumulated Depreciation", "減価償却累計額"),
    ("Intangible Assets", "無形固定資産"),
    ("Financial Assets", "金融資産"),
    ("Investments", "投資"),
    ("Long-term Loan", "長期貸付金"),
    ("Other Financial Assets", "その他の金融資産"),
    ("Other Fixed Assets", "その他の固定資産"),
    ("Deferred Charges", "繰延資産"),
    ("Total Assets", "総資産"),
)

# Facts of a parser's document map and how they are shown, in order.
MAP_LABELS = (
    ("title", "Document title"),
    ("document_type", "Document type"),
    ("type_confidence", "Type confidence"),
    ("has_encoding_issues", "Text layer has encoding problems"),
    ("complex_layout", "Complex multi-column layout"),
    ("pages_with_tables", "Pages containing tables"),
    ("table_page_count", "Number of pages with tables"),
    ("table_count", "Tables detected"),
    ("largest_tables", "Table shapes (page: rows x cols)"),
    ("pages_with_multiple_columns", "Pages with multiple columns"),
    ("pages_needing_ocr", "Pages whose text layer is unreadable"),
    ("ocr_pages", "Pages replaced by OCR"),
    ("native_text_fallback_pages", "Text-based pages recovered from their embedded text layer"),
    ("selected_pages", "Pages retained by the intelligent scanning gate"),
    ("selected_page_count", "Pages sent for semantic mapping"),
    ("character_reduction_percent", "Markdown character reduction (%)"),
    ("outline", "Document outline"),
    ("outline_entries_total", "Outline entries in document"),
)


def leaves(total: str) -> int:
    """How many schema leaves a total is made of."""
    parts = dict(IDENTITIES)
    return sum(leaves(p) if p in parts else 1 for p in parts[total])


def fold(name: str) -> str:
    """Lower-cased name with ``&`` spelled out and other marks blanked."""
    return " ".join(re.sub(r"[^a-z0-9]+", " ", name.lower().replace("&", " and ")).split())


def names() -> list[tuple[str, str]]:
    """(folded, item): canonical names first, then variants; the first entry of a folded name wins."""
    out: dict[str, str] = {}
    for folded, item in [*((fold(i), i) for i in ITEMS), *((fold(a), i) for a, i in ALIASES)]:
        out.setdefault(folded, item)
    return [*out.items()]


def schema_dim(spark: SparkSession) -> DataFrame:
    rows = [(k, *r) for k, r in enumerate(SCHEMA)]
    return spark.createDataFrame(rows, "ord int, classification string, subclassification string, item string")


def edges_dim(spark: SparkSession) -> DataFrame:
    """(total_ord, total, part, leaves): one row per part of an identity."""
    rows = [(k, t, p, leaves(t)) for k, (t, parts) in enumerate(IDENTITIES) for p in parts]
    return spark.createDataFrame(rows, "total_ord int, total string, part string, leaves int")


def names_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(names(), "folded string, item string")


def strategies_dim(spark: SparkSession) -> DataFrame:
    rows = [(k, *r) for k, r in enumerate(STRATEGIES)]
    return spark.createDataFrame(rows, "ord int, strategy string, prefix string, parser string, experiment string, ocr string")


def labels_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*JAPANESE], "en string, ja string")


def map_labels_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *r) for k, r in enumerate(MAP_LABELS)], "ord int, key string, label string")
