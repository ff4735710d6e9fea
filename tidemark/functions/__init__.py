from tidemark.functions import exprs

__all__ = ["exprs"]
