"""acequia: irrigation analytics over many weather stations, as Spark jobs."""
