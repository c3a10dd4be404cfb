from tidemark.functions.calendar import epoch_millis, epoch_seconds, iso_utc, month_windows, week_start
from tidemark.functions.numeric import as_number, direction, finite, persistence, share, sigmoid, sign_flags
from tidemark.functions.text import clean_text, keyword_hits, word_tokens

__all__ = [
    "as_number", "clean_text", "direction", "epoch_millis", "epoch_seconds", "finite", "iso_utc",
    "keyword_hits", "month_windows", "persistence", "share", "sigmoid", "sign_flags", "week_start",
    "word_tokens",
]
