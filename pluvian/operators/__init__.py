"""DataFrame -> DataFrame operators; every one is lazy unless its docstring says otherwise."""
