"""kickframe: DataFrame operators for sports-video time series and the tables around them."""
