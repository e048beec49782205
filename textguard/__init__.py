"""textguard: text cleaning, gated rewriting and rewrite evaluation on Spark DataFrames."""

__version__ = "0.1.0"
