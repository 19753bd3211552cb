"""Column expressions and text helpers."""
