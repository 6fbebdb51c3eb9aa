"""Column expressions. Everything here stays in Catalyst unless its docstring says otherwise."""
