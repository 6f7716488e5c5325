"""cotejo: claim-against-corpus verification as bulk Spark plans."""
