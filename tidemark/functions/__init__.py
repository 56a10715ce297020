"""Statistical functions used by analyses."""
