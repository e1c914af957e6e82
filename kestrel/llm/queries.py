"""Queries of this subpackage: name -> callable(spark, sf_dir), and their SQL."""

from __future__ import annotations

from .automata import SQL_OP9, op9_suffix_automata
from .chat import SQL_OP2, op2_chat_formatting
from .decontaminate import op5_decontamination
from .fill_middle import SQL_OP13, op13_fill_middle
from .jaccard import SQL_OP6, op6_jaccard_join
from .lexical_search import SQL_OP12, op12_lexical_search
from .mixing import SQL_OP10, op10_mixing
from .prefix_free import SQL_OP7, op7_prefix_free
from .quality_rules import op4_quality_rules
from .sharding import op1_sharding
from .suffix_tree import op11_suffix_tree
from .url_filters import SQL_OP3, op3_url_filters
from .weak_labels import op8_quality_classifier

QUERIES = {f.__name__: f for f in (
    op1_sharding, op2_chat_formatting, op3_url_filters, op4_quality_rules,
    op5_decontamination, op6_jaccard_join,
    op7_prefix_free, op8_quality_classifier, op9_suffix_automata, op10_mixing, op11_suffix_tree, op12_lexical_search, op13_fill_middle)}

ORACLE = {"op2_chat_formatting": SQL_OP2, "op3_url_filters": SQL_OP3, "op6_jaccard_join": SQL_OP6, "op7_prefix_free": SQL_OP7,
          "op9_suffix_automata": SQL_OP9, "op10_mixing": SQL_OP10, "op12_lexical_search": SQL_OP12, "op13_fill_middle": SQL_OP13}
