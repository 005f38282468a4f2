"""DataFrame -> DataFrame operators the reports are composed from."""
