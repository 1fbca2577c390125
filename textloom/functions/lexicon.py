"""Word lists and tables."""

# They must be exactly these for results to agree.
ARCHAIC = "afore anon art aught dost doth ere hath hence hither mayst methinks naught nay nigh oft shalt thee thine thou thy tis twas whence wherefore whilst ye".split()
ACADEMIC = "algorithm analysis approach baseline classifier corpus dataset evaluation experiment language method model parameter precision recall representation result semantic statistical syntax system task training".split()
POETIC = "dew flame glen grace heart heaven moon muse poem poesy rhyme sea sonnet star stars thou thy verse".split()
LEDGER_ARCHAIC = "afore aforetime aire anon art aught brighte calme darknesse dost doth eke ere glowe hath hence hither hower lighte mayst methinks moone naught nighte o'er oft plighte shalt skie starres streche thee thine thou thy tis twas whence wherefore ye".split()
LEDGER_ACADEMIC = "algorithm analysis approach baseline corpus data dataset evaluation experiment method model paper parameter precision recall result statistical study system table task training".split()
LEDGER_POETIC = "art banner chief dew flame glen grace grass hail heart heaven line measure moon muse muses music pine poem poems poesy poetry rhyme romance sand seaweed silken sky sonnet stars temple triumph tune waves".split()
FUNCTION_WORDS = "a an and are as at be been but by for from had has have he her his i if in is it its not of on or she that the their there they this to was we were which who with you".split()
FIRST_PERSON = "i me my mine we our".split()
HARDNESS_TOKENS = ["thou", "thee", "hath", "doth", "ere", "nay"]
OLD_PROSE = r"\b(whilst|whereupon|thereof|hitherto|nay|alas|ere|hath|doth)\b"
CITATION = r"\([A-Z][A-Za-z-]+,\s*\d{4}\)|\bet al\.\b|\btable\s+\d+|\bfigure\s+\d+"
VALID_ENDINGS = [".", "?", "!", ")", "]", '"', "'", "”", "’"]
META_PREFIXES = ["here is the rewritten passage", "here is the rewrite", "here is the rewritten paragraph", "rewritten passage:", "rewritten paragraph:", "paraphrased passage:", "paraphrased paragraph:", "modernized passage:", "the rewritten passage is:", "below is", "certainly!", "sure,", "of course,", "as requested,", "i have rewritten"]
PROMPT_LEAKAGE = [r"\bas an ai\b", r"\bi cannot\b", r"\bi can't\b", r"\bsure[,! ]+here", r"\bhere is (the )?(rewrite|paraphrase)", r"\brewritten (version|text)", r"\breturn only\b"]
POETRY_BAD = ["project gutenberg", "ebook", "license", "copyright", "table of contents", "contents", "index", "transcriber's note", "british museum", "edition", "editor", "manuscript", "line-numbers", "line numbers", "introduction and notes", "poetic career", "poetical works", "facsimile", "end of the project gutenberg", "start of the project gutenberg"]
PARAGRAPH_BAD = ["project gutenberg", "ebook", "license", "copyright", "contents", "chapter", "table of contents", "illustration"]
ACADEMIC_BAD = ["http://", "https://", "www.", "copyright", "isbn", "all rights reserved"]
ACADEMIC_KEYWORDS = ["parsing", "parser", "syntax", "syntactic", "semantic", "semantics", "machine translation", "translation", "alignment", "coreference", "pronoun", "discourse", "grammar", "language model", "natural language generation", "generation", "summarization", "evaluation", "ambiguity", "corpus", "annotation", "dependency", "constituency"]
BAD_SECTIONS = ["references", "bibliography", "acknowledgements", "acknowledgments", "appendix", "related work"]
NOISE_MARKERS = ['"pattern"', '"spec"', '"orth"', '"node_name"', "ent_type", "nbor_relop"]
HIGH_RISK = ["academic_formal", "literary_old_prose", "literary_short_fragment", "ornate_literary_prose", "poetry_classical", "poetry_freeverse", "short_fragment"]
BUCKET_GROUPS = {
    "all": [],
    "planned_high_risk": ["academic_formal", "literary_old_prose", "literary_short_fragment", "poetry_classical", "poetry_freeverse"],
    "literary_poetry": ["literary_old_prose", "literary_short_fragment", "poetry_classical", "poetry_freeverse"],
    "old_short": ["literary_old_prose", "literary_short_fragment"],
    "poetry": ["poetry_classical", "poetry_freeverse"],
    "academic": ["academic_formal"],
}
BUCKET_POLICIES = {
    "old_short": {"base": ["literary_short_fragment", "literary_old_prose"], "general": []},
    "short_only": {"base": ["literary_short_fragment"], "general": []},
    "general_strict": {"base": [], "general": ["general_prose"]},
    "old_short_plus_general_strict": {"base": ["literary_short_fragment", "literary_old_prose"], "general": ["general_prose"]},
}
QUOTES = {"‘": "'", "’": "'", "‚": "'", "‛": "'", "′": "'", "‵": "'", "“": '"', "”": '"', "„": '"', "‟": '"', "″": '"', "‶": '"'}
DASHES = "‐‑‒–—―−"
SPACES = "               　"
INVISIBLE = "​‌‍﻿"
# Mis-decoded UTF-8, in the order of replacement.
MOJIBAKE = [("â€™", "'"), ("â€˜", "'"), ("â€œ", '"'), ("â€�", '"'), ("â€\x9d", '"'), ("â€“", "-"), ("â€”", "-"), ("â€•", "-"), ("â€¦", "..."), ("â€", '"'), ("Â ", " "), ("Â", ""), ("Ã©", "é"), ("Ã¨", "è"), ("Ã¡", "á"), ("Ã ", "à"), ("Ã¢", "â"), ("Ãª", "ê"), ("Ã®", "î"), ("Ã´", "ô"), ("Ã¶", "ö"), ("Ã¼", "ü"), ("Ã±", "ñ")]
