"""DataFrame operators on streets, locations, geometry and the registry."""
