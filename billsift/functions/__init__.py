"""Column functions."""

from billsift.functions.fields import (
    amount_lines,
    find_amount,
    find_contains,
    find_percent,
    first_line,
    first_match,
    first_with,
    joined,
    label_value,
    last_amount,
    percent_lines,
    pick_amount,
    pick_percent,
)
from billsift.functions.items import is_item, items, pipe_join, structured_items
from billsift.functions.parties import (
    anchor_is_last,
    anchor_position,
    buyer_address,
    buyer_gstin,
    buyer_name,
    vendor_address,
    vendor_name,
)
from billsift.functions.secure import decrypt, derive_key, encrypt, key_column
from billsift.functions.text import (
    content_hash,
    normalize_currency,
    quality_score,
    redact,
    run_stamp,
    safe_path,
    sanitize_cell,
    strip_ws,
    text_lines,
    variant_slug,
)
from billsift.functions.typed import to_day, to_money, to_rate

__all__ = [
    "amount_lines",
    "anchor_is_last",
    "anchor_position",
    "buyer_address",
    "buyer_gstin",
    "buyer_name",
    "content_hash",
    "decrypt",
    "derive_key",
    "encrypt",
    "find_amount",
    "find_contains",
    "find_percent",
    "first_line",
    "first_match",
    "first_with",
    "is_item",
    "items",
    "joined",
    "key_column",
    "label_value",
    "last_amount",
    "normalize_currency",
    "percent_lines",
    "pick_amount",
    "pick_percent",
    "pipe_join",
    "quality_score",
    "redact",
    "run_stamp",
    "safe_path",
    "sanitize_cell",
    "strip_ws",
    "structured_items",
    "text_lines",
    "to_day",
    "to_money",
    "to_rate",
    "variant_slug",
    "vendor_address",
    "vendor_name",
]
