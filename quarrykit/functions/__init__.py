"""See the package README for the operators held here."""
