"""Part of larkspur; see the package README."""
