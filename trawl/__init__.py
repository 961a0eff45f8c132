"""trawl: a Spark-native suite for building monolingual text corpora from stored web pages.

Every public operator takes and returns DataFrames; the heavy lifting is Catalyst-planned
DataFrame work. The only Python on the data path is the Arrow-batched HTML pass
(``trawl.operators.html``), because an HTML tree cannot be expressed with column functions.
"""

__version__ = "0.1.0"
