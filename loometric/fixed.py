"""Fixed values that results depend on. They are data, not logic."""

# Unicode white space as Python's str.split() and str.strip() see it (fixed values).
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Label id of positions that take no part in training or scoring (fixed value).
IGNORE_ID = -100

# Word-start mark of byte-level subword vocabularies (fixed value).
WORD_START = "Ġ"

# Turn marks of the chat format (fixed values).
BOS = "<bos>"
TURN_START = "<start_of_turn>"
TURN_END = "<end_of_turn>\n"
INSTRUCTION_PART = "<start_of_turn>user\n"
RESPONSE_PART = "<start_of_turn>model\n"
RESPONSE_MARK = "model\n"

# Marks of the question sheet (fixed values).
QUESTION_MARK = "Soru:"
ANSWER_MARK = "Cevap:"
LAW_MARK = "İlgili Yasa:"

# Smallest positive normal double: stands in for a zero n-gram precision in BLEU (fixed value).
SMALLEST_NORMAL = 2.2250738585072014e-308
