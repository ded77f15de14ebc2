from oracle.statements import statements

__all__ = ["statements"]
