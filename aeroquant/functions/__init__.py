"""Column expressions; all run inside whole-stage code generation."""
