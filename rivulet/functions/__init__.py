"""Column functions: no UDFs, all inside whole-stage code generation."""
