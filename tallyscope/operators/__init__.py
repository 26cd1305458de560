"""DataFrame-in, DataFrame-out operators over the ledger model."""
