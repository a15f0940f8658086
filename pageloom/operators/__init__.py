"""DataFrame operators over the node table and the outcome table."""
