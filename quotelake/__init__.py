"""quotelake: price and offer intelligence as Spark DataFrame operators."""
