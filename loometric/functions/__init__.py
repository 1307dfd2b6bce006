from loometric.functions.numeric import (
    argmax_label,
    bce_with_logits,
    cross_entropy,
    format_metric,
    percent,
    softmax,
)
from loometric.functions.stage import computed
from loometric.functions.text import (
    clean_cell,
    entity_type,
    fill_prompt,
    join_tokens,
    let,
    normalize_text,
    run_name,
    safe_name,
    split_words,
    strip,
    strip_suffix,
    token_counter,
    word_count,
)

__all__ = [
    "argmax_label",
    "bce_with_logits",
    "clean_cell",
    "computed",
    "cross_entropy",
    "entity_type",
    "fill_prompt",
    "format_metric",
    "join_tokens",
    "let",
    "normalize_text",
    "percent",
    "run_name",
    "safe_name",
    "softmax",
    "split_words",
    "strip",
    "strip_suffix",
    "token_counter",
    "word_count",
]
