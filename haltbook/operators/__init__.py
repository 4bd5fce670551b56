"""DataFrame operators on notices, assets, events and incidents."""
