"""sway — answer-consistency data engine on Spark.

Measure how consistently language models answer when their first answer is
challenged, and prepare the data around it, as DataFrame operators.
"""

__version__ = "0.1.0"
