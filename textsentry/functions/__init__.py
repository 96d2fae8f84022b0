"""Column expressions: text helpers and regex primitives."""
