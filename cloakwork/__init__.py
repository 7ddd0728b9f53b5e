"""Personal data in text columns: found, replaced, and grouped by identity, with DataFrames."""

from .functions.spans import PII_TYPES
from .functions.text import detect_script, normalize, tokenize
from .operators.detect import detect, mapping_rows, redact, resolve, sanitize, segments, word_table
from .operators.identity import link_name_parts, resolve_identities, sanitize_text
from .operators.namedb import build_dictionary, core_dictionary
from .operators.names import Dictionary
from .operators.structured import register_detector
from .sources.packs import BloomFilter, read_packs, write_packs

__all__ = [
    "PII_TYPES", "BloomFilter", "Dictionary", "build_dictionary", "core_dictionary", "detect", "detect_script", "link_name_parts",
    "mapping_rows", "normalize", "read_packs", "redact", "register_detector", "resolve", "resolve_identities", "sanitize",
    "sanitize_text", "segments", "tokenize", "word_table", "write_packs",
]
