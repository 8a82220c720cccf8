"""DataFrame to DataFrame operators; rules, prices and limits are arguments."""
