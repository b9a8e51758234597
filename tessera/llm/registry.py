"""The queries of the training-data operators, and the SQL that expresses those which SQL can express."""

from .bpe import op4_bpe
from .fim import ORACLE as FIM_SQL
from .fim import op13_fim
from .fingerprint import op5_fingerprint
from .fixity import ORACLE as FIXITY_SQL
from .fixity import op3_fixity
from .html_text import op10_html_text
from .language import op8_language_id
from .minhash import op6_minhash
from .mixing import op7_mixing
from .packing import op11_packing
from .quality import op1_quality
from .toxicity import op9_toxicity
from .trie import ORACLE as TRIE_SQL
from .trie import op12_prefix_trie
from .vectors import ORACLE as VECTORS_SQL
from .vectors import op2_vectors

QUERIES = {
    "op1_quality": op1_quality,
    "op2_vectors": op2_vectors,
    "op3_fixity": op3_fixity,
    "op4_bpe": op4_bpe,
    "op5_fingerprint": op5_fingerprint,
    "op6_minhash": op6_minhash,
    "op7_mixing": op7_mixing,
    "op8_language_id": op8_language_id,
    "op9_toxicity": op9_toxicity,
    "op10_html_text": op10_html_text,
    "op11_packing": op11_packing,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_fim": op13_fim,
}

ORACLE_SQL: dict[str, str] = {
    "op2_vectors": VECTORS_SQL,
    "op3_fixity": FIXITY_SQL,
    "op12_prefix_trie": TRIE_SQL,
    "op13_fim": FIM_SQL,
}
